"""Text cleaning as Column expressions; the order of the steps is part of the semantics."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STRIP = "(?U)^\\s+|\\s+$"

# The cleaner's literal replacements, applied in this order.
CONVERSIONS: dict[str, str] = {
    "aa": "å",
    "ğ": "g",
    "ñ": "n",
    "ń": "n",
    "è": "e",
    "kg": " kilo ",
    "μg": " mikrogram ",
    "hhv": "henholdsvis",
    "fx": "for eksempel",
    "f.eks.": "for eksempel",
    "-": " minus ",
    "+": " plus ",
    "μ": " mikro ",
    "§": " paragraf ",
    "%": " procent ",
    "‰": " promille ",
    "ú": "u",
    "ş": "s",
    "ê": "e",
    "ã": "a",
    "ë": "e",
    "ć": "c",
    "ä": "æ",
    "í": "i",
    "š": "s",
    "î": "i",
    "ě": "e",
    "ð": "d",
    "á": "a",
    "ó": "o",
    "þ": "th",
    "ı": "i",
    "ö": "ø",
    "ç": "c",
    "ș": "s",
    "\u0301": " ",
    "\u200b": " ",
}
# Fixed value: hesitation words.
FILLERS = "\\b(?:eh+m*|øh+m*|h+m+|m+h+)\\b"


def strip(c: Column) -> Column:
    """Python's strip: all Unicode white space, unlike trim, which takes blanks only."""
    return F.regexp_replace(c, STRIP, "")


def remove_fillers(c: Column) -> Column:
    return F.regexp_replace(c, "(?iU)" + FILLERS, "")


def convert(c: Column, conversions: dict[str, str] = CONVERSIONS) -> Column:
    """Ordered, case-sensitive substring replacement."""
    for old, new in conversions.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def keep_characters(c: Column, keep: str | None) -> Column:
    """Strip, then a blank for every character that is not kept (case ignored); None keeps all."""
    c = strip(c)
    if keep is None:
        return c
    allowed = "".join(re.sub(r"([\\\[\]^\-&])", r"\\\1", x) for x in dict.fromkeys(keep + " |"))
    return F.regexp_replace(c, f"(?iu)[^{allowed}]", " ")


def tidy(c: Column) -> Column:
    """One blank for runs of blanks; lines stripped; no line breaks at the ends."""
    c = F.regexp_replace(c, " +", " ")
    c = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    return F.regexp_replace(c, "^\n+|\n+$", "")


def clean(c: Column, lower: bool = True, keep: str | None = None, conversions: dict[str, str] = CONVERSIONS, nfkc: bool = False) -> Column:
    """The cleaner without numerals: case, fillers, compatibility forms, conversions, kept characters, blanks.

    Compatibility normalisation has no built-in and costs an Arrow UDF; without
    it everything stays in generated code.
    """
    if lower:
        c = F.lower(c)
    c = remove_fillers(c)
    if nfkc:
        c = nfkc_normalise(c)
    return tidy(keep_characters(convert(c, conversions), keep))


@F.pandas_udf(StringType())
def nfkc_normalise(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def strip_unknown(c: Column) -> Column:
    """Drop ``<UNK>`` and strip."""
    return strip(F.replace(c, F.lit("<UNK>"), F.lit("")))


# Fixed value: the text of a recording without words.
SILENCE = "( ... tavshed under denne indspilning ...)"


def blank_to_null(c: Column, placeholders: tuple[str, ...] = ("", SILENCE)) -> Column:
    """Null for empty texts and placeholders."""
    return F.when(~c.isin(*placeholders), c)


def original_filename(c: Column) -> Column:
    """Lower case, last part after ``-`` and ``_``, without ``.wav``."""
    last = F.element_at(F.split(F.element_at(F.split(F.lower(c), "-"), -1), "_"), -1)
    return F.replace(last, F.lit(".wav"), F.lit(""))


def mangle(c: Column) -> Column:
    """A model or data set id as a file name: ``/`` to ``--``, ``.`` and ``::`` to ``-``."""
    return F.replace(F.replace(F.replace(c, F.lit("/"), F.lit("--")), F.lit("::"), F.lit("-")), F.lit("."), F.lit("-"))


def links(c: Column) -> Column:
    """Targets of the anchors of an HTML text."""
    return F.regexp_extract_all(c, F.lit('<a href="(.+?)">'), 1)


def parse_dataset_name(name: str) -> tuple[str, str | None, str | None]:
    """``id[::subset][@revision]``, in either order of the two suffixes; a single colon counts as double."""
    if name.count("@") > 1:
        raise ValueError(f"more than one @ in {name!r}")
    name = re.sub(r"(?<!:):(?!:)", "::", name)
    if name.count("::") > 1:
        raise ValueError(f"more than one :: in {name!r}")
    parts = re.fullmatch(r"([^@:]+)(?:(?:::([^@:]+))?(?:@([^@:]+))?|@([^@:]+)::([^@:]+))", name)
    if not parts:
        raise ValueError(f"not a data set name: {name!r}")
    return parts[1], parts[2] or parts[5], parts[3] or parts[4]


def dataset_name_columns(c: Column) -> dict[str, Column]:
    """The same as columns: id, subset, revision."""
    n = F.regexp_replace(c, "(?<!:):(?!:)", "::")
    part = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit(""))
    return {"id": part("^([^@:]+)"), "subset": part("::([^@:]+)"), "revision": part("@([^@:]+)")}
