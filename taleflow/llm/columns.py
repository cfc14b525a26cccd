"""Canonical forms of the fields of samples, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "(?U)[\\s\\u200b\\ufeff]+"


def squeezed(c: Column) -> Column:
    """Lower case, blanks trimmed and runs of blanks made one."""
    return F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))


def speaker(c: Column) -> Column:
    """``spe_`` and the lower-case identifier; null and empty values give null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", ""), "^spe", "")
    return F.when(bare != "", F.concat(F.lit("spe_"), bare))


def conversation(c: Column) -> Column:
    """Lower case without blanks; null and empty values give null."""
    bare = F.regexp_replace(F.lower(c), BLANKS, "")
    return F.when(bare != "", bare)


def split_role(c: Column) -> Column:
    """'train', 'eval' or null."""
    s = squeezed(c)
    return F.when(s.startswith("train"), "train").when(s.startswith("val") | s.startswith("dev") | s.startswith("test"), "eval")


def source(c: Column) -> Column:
    """Source name without case, blanks, separator variants and the ending ``_da``; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), BLANKS, ""), "-", "_")
    return F.regexp_replace(bare, "_da$", "")


#: Spellings of the three genders, in Danish and English.
GENDERS = {
    "female": ("female", "f", "k", "kvinde", "kvindelig", "woman", "girl", "pige", "hunkøn"),
    "male": ("male", "m", "mand", "mandlig", "man", "boy", "dreng", "hankøn"),
    "nonbinary": ("nonbinary", "nb", "enby", "nonbinær", "ikkebinær", "ikkebinary", "nonbinaer", "ikkebinaer", "x"),
}


def gender(c: Column) -> Column:
    bare = F.regexp_replace(squeezed(c), "[^a-zæøå]+", "")
    out = F.when(bare.isin(*GENDERS["female"]), "female")
    for name in ("male", "nonbinary"):
        out = out.when(bare.isin(*GENDERS[name]), name)
    return out


def age_group(c: Column) -> Column:
    """0-24, 25-49 or 50-; ages outside 1 to 110 are missing."""
    return F.when(c.between(1, 24), "0-24").when(c.between(25, 49), "25-49").when(c.between(50, 110), "50-")
