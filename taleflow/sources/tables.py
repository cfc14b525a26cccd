"""Table scans of a data folder, one Parquet table per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lazily scan ``folder/name.parquet`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
