"""Danish numerals in words, by a closed rule over a table of 0..999."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Danish number words.
UNITS = (
    "nul", "en", "to", "tre", "fire", "fem", "seks", "syv", "otte", "ni", "ti", "elleve", "tolv", "tretten", "fjorten", "femten", "seksten", "sytten", "atten", "nitten",
)
TENS = {20: "tyve", 30: "tredive", 40: "fyrre", 50: "halvtreds", 60: "tres", 70: "halvfjerds", 80: "firs", 90: "halvfems"}

# Fixed value: what counts as a numeral.
NUMBER = r"(0|[1-9]\d{0,2}(?:(?:\.\d{3})*|\d*)(?:,\d+)?)"
NUMERAL = rf"(?U)\b{NUMBER}\b"


def below_thousand(n: int) -> str:
    if n < 20:
        return UNITS[n]
    if n < 100:
        ten = TENS[n - n % 10]
        return ten if n % 10 == 0 else f"{UNITS[n % 10]}og{ten}"
    head = ("et" if n // 100 == 1 else UNITS[n // 100]) + " hundrede"
    return head if n % 100 == 0 else f"{head} og {below_thousand(n % 100)}"


def word_table(spark: SparkSession) -> DataFrame:
    """One row with the array of the words of 0..999; broadcast once per query."""
    return spark.createDataFrame([([below_thousand(i) for i in range(1000)],)], "number_words array<string>")


def spoken(numeral: Column, table: Column) -> Column:
    """Words of one numeral: ``.`` groups thousands, ``,`` starts decimals; anything else, and ten digits or more, stays."""
    whole = F.replace(F.substring_index(numeral, ",", 1), F.lit("."), F.lit(""))
    v = whole.try_cast("long")
    m, k, u = F.floor(v / 1_000_000), F.floor(v / 1000) % 1000, v % 1000
    t = lambda i: F.get(table, i.cast("int"))
    rest = lambda x, words: F.when(x == 0, "").when(x < 100, F.concat(F.lit(" og "), words)).otherwise(F.concat(F.lit(" "), words))
    low = v % 1_000_000
    thousands = F.concat(F.when(k == 1, "et").otherwise(t(k)), F.lit(" tusind"), rest(u, t(u)))
    lower = F.when(k > 0, thousands).otherwise(t(u))
    millions = F.concat(t(m), F.when(m == 1, " million").otherwise(" millioner"), rest(low, lower))
    words = F.when(v == 100, "hundrede").when(v == 1000, "tusind").when(v < 1000, t(v)).when(v < 1_000_000, lower).otherwise(millions)
    words = F.when(F.length(whole) > 9, whole).otherwise(words)
    # of its own: a Python function whose argument has a lambda within a lambda that refers to the outer one is not found by the planner
    decimals = F.array(*[F.lit("et" if i == 1 else w) for i, w in enumerate(UNITS[:10])])
    digits = F.transform(F.split(F.substring_index(numeral, ",", -1), ""), lambda d: F.get(decimals, d.try_cast("int")))
    full = F.when(F.instr(numeral, ",") > 0, F.concat(words, F.lit(" komma "), F.array_join(digits, " "))).otherwise(words)
    ok = numeral.rlike(f"^{NUMBER}$")
    return F.when(ok, full).otherwise(numeral)


def verbalise(text: Column, table: Column) -> Column:
    """Every numeral of a text in words."""
    return _replaced(text, F.transform(F.regexp_extract_all(text, F.lit(NUMERAL), 0), lambda n: spoken(n, table)))


def in_words(text: Column) -> Column:
    """The same with the word table as a constant: no row carries it along, as rows that wait for a Python worker would."""
    table = F.split(F.lit(",".join(below_thousand(i) for i in range(1000))), ",")
    found = F.regexp_extract_all(text, F.lit(NUMERAL), 0)
    # the table beside each numeral, so that it stands in the plan once and not for each of its uses
    beside = F.arrays_zip(found.alias("n"), F.array_repeat(table, F.size(found)).alias("table"))
    return _replaced(text, F.transform(beside, lambda x: spoken(x["n"], x["table"])))


def _replaced(text: Column, found: Column) -> Column:
    """The text with ``found`` in the places of its numerals."""
    gaps = F.split(text, NUMERAL, -1)
    spoken_ = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("n")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["n"], F.lit("")))), "")
    # most texts have no digit at all
    return F.when(text.rlike(r"(?U)\d"), spoken_).otherwise(text)


def with_words(df: DataFrame) -> DataFrame:
    """``df`` with the word table attached as column number_words."""
    return df.crossJoin(F.broadcast(word_table(df.sparkSession)))  # one row
