"""Vocabulary, labels and padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audio import pad_to


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Sorted distinct characters with their index; ``|`` stands for the blank."""
    chars = df.select(F.explode(F.array_distinct(F.split(F.replace(F.col(text), F.lit(" "), F.lit("|")), ""))).alias("char")).filter("char <> ''").distinct()
    bounded = chars.agg(F.array_sort(F.collect_set("char")).alias("cs"))  # an alphabet, not data
    return bounded.select(F.posexplode("cs").alias("id", "char")).select("char", "id")


def label_ids(df: DataFrame, text: str, vocab: list[str], out: str = "labels") -> DataFrame:
    """Characters as vocabulary indices; unknown characters get the size of the vocabulary."""
    place = F.create_map(*[x for i, c in enumerate(vocab) for x in (F.lit(c), F.lit(i))])
    chars = F.filter(F.split(F.replace(F.col(text), F.lit(" "), F.lit("|")), ""), lambda c: c != "")
    return df.withColumn(out, F.transform(chars, lambda c: F.coalesce(F.try_element_at(place, c), F.lit(len(vocab)))))


def collate(df: DataFrame, batch: str, labels: str = "labels", cap: int = 512, drop_start: int | None = None) -> DataFrame:
    """Labels padded with -100 to the longest of their batch, at most ``cap``; a start token that begins every row of the batch is dropped."""
    rows = df.withColumn(labels, F.slice(labels, 1, cap))
    per = rows.groupBy(batch).agg(F.max(F.size(labels)).alias("__longest"), F.min((F.get(labels, 0) == F.lit(drop_start)).cast("int") if drop_start is not None else F.lit(0)).alias("__all"))
    out = rows.join(per, batch).withColumn(labels, pad_to(F.col(labels), F.col("__longest"), -100))
    return out.withColumn(labels, F.when(F.col("__all") == 1, F.slice(labels, 2, cap)).otherwise(F.col(labels))).drop("__longest", "__all")
