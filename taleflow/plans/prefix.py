"""Prefix sums whose work is split over all tasks, whatever the group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(order: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a signed 64-bit hash, monotone in the hash."""
    return F.least(F.floor((order.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * buckets).cast("int"), F.lit(buckets - 1))


def prefix_sum(df: DataFrame, keys: list[str], order: str, tie: list[str], value: str, out: str, buckets: int = 64, total: str | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in ``keys``, ordered by ``order`` then ``tie``.

    ``order`` is a signed 64-bit hash column. Rows are cut into ``buckets``
    ranges of the hash: the sums of all (keys, bucket) come from one map-side
    combined aggregate, their running sums from a window over that small
    table, and the rows of one bucket only meet each other. So a key with a
    third of all rows spreads over ``buckets`` tasks. ``total`` names an extra
    column with the sum of the whole group.
    """
    b, base = f"__{out}_bucket", f"__{out}_base"
    df = df.withColumn(b, bucket_of(F.col(order), buckets))
    sums = df.groupBy(*keys, b).agg(F.sum(value).alias("__s"))
    w = Window.partitionBy(*keys).orderBy(b)
    cols = [F.coalesce(F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base)]
    if total:
        cols.append(F.sum("__s").over(Window.partitionBy(*keys)).alias(total))
    bases = sums.select(*keys, b, *cols)
    inner = Window.partitionBy(*keys, b).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    cond = [df[k].eqNullSafe(bases[k]) for k in [*keys, b]]
    joined = df.join(bases, cond, "left")
    return joined.select(*[df[c] for c in df.columns if c not in (b, "__in")], (F.col("__in") + bases[base]).alias(out), *([bases[total]] if total else []))


def dense_numbers(df: DataFrame, part: str, within: str, out: str) -> DataFrame:
    """Numbers from 1 over ordered parts: ``within`` rises by one from row to row of a part. Both columns are dropped.

    Only one small row per part is sorted.
    """
    sizes = df.groupBy(part).agg(F.count("*").alias("__n"), F.min(within).alias("__least"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(part, F.col("__least"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return df.join(before, part).withColumn(out, F.col("__before") + F.col(within) - F.col("__least") + 1).drop(part, within, "__least", "__before")
