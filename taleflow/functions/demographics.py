"""Age groups, dialects and other speaker fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_int(c: Column) -> Column:
    """Null for what is no integer."""
    return c.try_cast("int")


def age_group(age: Column, bounds: tuple[tuple[int, int | None], ...] = ((0, 25), (25, 50), (50, None)), strict: bool = False) -> Column:
    """Half-open groups labelled ``0-24``, ``50-``; an age in none is null or, if strict, an error."""
    out = None
    for low, high in bounds:
        p = (age >= low) & ((age < high) if high is not None else F.lit(True))
        label = f"{low}-{high - 1}" if high is not None else f"{low}-"
        out = F.when(p, label) if out is None else out.when(p, label)
    return out.otherwise(F.raise_error(F.lit("age in no group"))) if strict else out


def evaluation_age_group(age: Column, strict: bool = False) -> Column:
    """``0-25``, ``25-50``, ``50+``. The scoring code leaves out 25; here it counts as 25-50 unless strict."""
    low = 26 if strict else 25
    return F.when((age >= 0) & (age < 25), "0-25").when((age >= low) & (age < 50), "25-50").when(age >= 50, "50+")


def main_dialect(df: DataFrame, mapping: DataFrame, sub: str = "dialect", country: str | None = "country_birth", strict: bool = False) -> DataFrame:
    """Sub-dialect replaced by its dialect, Non-native for speakers born outside DK (null means DK).

    A sub-dialect that is not in the mapping becomes null or, if ``strict``, an
    error when the rows are read. Of a sub-dialect given twice the least
    dialect counts.
    """
    m = mapping.groupBy(F.col("sub_dialect").alias("__sub")).agg(F.min("dialect").alias("__main"))
    out = df.join(m, df[sub] == m["__sub"], "left")
    value = F.col("__main")
    if strict:
        missing = F.col(sub).isNotNull() & F.col("__sub").isNull()
        value = F.when(missing, F.raise_error(F.concat(F.lit("no dialect for "), F.col(sub)))).otherwise(value)
    if country:
        value = F.when(F.coalesce(F.col(country), F.lit("DK")) != "DK", "Non-native").otherwise(value)
    return out.withColumn("__value", value).drop("__main", "__sub", sub).withColumnRenamed("__value", sub).select(*df.columns)
