"""One sentence of our own for every rule of the cleaner; expected values follow from the rule."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taleflow.functions import numerals, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_case(spark):
    assert one(spark, "Færgen SEJLER", lambda c: text.clean(c, conversions={})) == "færgen sejler"
    assert one(spark, "Færgen SEJLER", lambda c: text.clean(c, lower=False, conversions={})) == "Færgen SEJLER"


@pytest.mark.parametrize("raw,want", [("hm det regner øhhm nu", "det regner nu"), ("ehmm mhh", ""), ("hymne og ehm-lyd", "hymne og -lyd")])
def test_fillers(spark, raw, want):
    assert one(spark, raw, lambda c: text.clean(c, conversions={})) == want


def test_conversions_go_in_order(spark):
    # the result of one replacement is seen by the next
    assert one(spark, "xyz", lambda c: text.convert(c, {"x": "y", "yy": "-", "y": "x"})) == "-z"
    for old, new in text.CONVERSIONS.items():
        alone = one(spark, f"1{old}1", lambda c: text.convert(c, {old: new}))
        assert alone == f"1{new}1"
    assert one(spark, "5 kg ost fx 10%", text.clean) == "5 kilo ost for eksempel 10 procent"


def test_kept_characters(spark):
    keep = "abcdeø.^-]"
    assert one(spark, " a^b-c]d, Eø|f ", lambda c: text.keep_characters(c, keep)) == "a^b-c]d  Eø| "
    assert one(spark, " ?!\t", lambda c: text.keep_characters(c, None)) == "?!"


def test_blanks_and_lines(spark):
    assert one(spark, "\n\n en   to \n tre\n \nfire\n", text.tidy) == "en to\ntre\n\nfire"


def test_compatibility_forms(spark):
    assert one(spark, "ﬁn ½ Ｈａｖ", lambda c: text.clean(c, conversions={}, nfkc=True)) == "fin 1⁄2 hav"


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n",)], "t string")
    assert [r[0] for r in df.select(text.clean(F.col("t"), nfkc=True)).collect()] == [None, "", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \n "), max_size=12), min_size=1, max_size=20))
def test_tidy_against_python(spark, raws):
    def want(s):
        return re.sub("^\n+|\n+$", "", "\n".join(x.strip() for x in re.sub(" +", " ", s).split("\n")))

    df = spark.createDataFrame([(i, s) for i, s in enumerate(raws)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.tidy(F.col("t")).alias("x")).collect()}
    assert got == {i: want(s) for i, s in enumerate(raws)}


def words(n):
    """The rule of number words, written a second time from the grammar."""
    if n >= 1_000_000:
        head, low = divmod(n, 1_000_000)
        return words(head).removesuffix("x") + (" million" if head == 1 else " millioner") + (f" og {words(low)}" if 0 < low < 100 else f" {words(low)}" if low else "")
    if n >= 1000:
        head, low = divmod(n, 1000)
        return ("et" if head == 1 else words(head)) + " tusind" + (f" og {words(low)}" if 0 < low < 100 else f" {hundreds(low)}" if low else "")
    return hundreds(n)


def hundreds(n):
    if n < 100:
        return numerals.below_thousand(n)
    head, low = divmod(n, 100)
    return ("et" if head == 1 else numerals.UNITS[head]) + " hundrede" + (f" og {numerals.below_thousand(low)}" if low else "")


def test_numerals_by_the_grammar(spark):
    import random

    rng = random.Random(8)
    ns = sorted({rng.randrange(10**k) for k in range(1, 7) for _ in range(40)} - {100, 1000})
    df = numerals.with_words(spark.createDataFrame([(str(n),) for n in ns], "n string"))
    got = [r[0] for r in df.select(numerals.spoken(F.col("n"), F.col("number_words"))).collect()]
    assert got == [words(n) for n in ns]


@pytest.mark.parametrize(
    "numeral,want",
    [("7", "syv"), ("38", "otteogtredive"), ("72", "tooghalvfjerds"), ("100", "hundrede"), ("1000", "tusind"), ("3.400", "tre tusind fire hundrede"), ("6,05", "seks komma nul fem"), ("2.000.002", "to millioner og to"), ("12.34.567", "12.34.567"), ("9.876.543.210", "9876543210")],
)
def test_numeral_forms(spark, numeral, want):
    df = numerals.with_words(spark.createDataFrame([(numeral,)], "n string"))
    assert df.select(numerals.spoken(F.col("n"), F.col("number_words"))).first()[0] == want


def test_numerals_in_text(spark):
    df = numerals.with_words(spark.createDataFrame([("bus 12 kører kl. 8,30 fra nr. 05",), ("ingen tal",), (None,), ("",)], "t string"))
    got = [r[0] for r in df.select(numerals.verbalise(F.col("t"), F.col("number_words"))).collect()]
    assert got == ["bus tolv kører kl. otte komma tre nul fra nr. 05", "ingen tal", None, ""]


def test_dataset_names():
    for name, want in {"korpus": ("korpus", None, None), "hus/korpus:tale": ("hus/korpus", "tale", None), "korpus::tale": ("korpus", "tale", None), "korpus@v2": ("korpus", None, "v2"), "k::t@v2": ("k", "t", "v2"), "k@v2::t": ("k", "t", "v2")}.items():
        assert text.parse_dataset_name(name) == want
    for bad in ("k@1@2", "k::s::t", ""):
        with pytest.raises(ValueError):
            text.parse_dataset_name(bad)
