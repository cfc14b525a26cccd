"""The cleaner, filters and counts on streams: the same Column expressions as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators.filters import has_text, none_of
from ..plans.storage import keep, shared_dir


def clean_stream(stream: DataFrame, text: str = "text", out: str = "clean_text", kept: str | None = None) -> DataFrame:
    """Cleaned non-blank, not rejected rows of a streaming (or batch) frame; no state is kept."""
    p = has_text(F.col(text))
    if "validated" in stream.columns:
        p = p & none_of(F.col("validated"), "rejected")
    return stream.filter(p).withColumn(out, clean(F.col(text), keep=kept))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per window and keys; rows later than ``late`` are left out once their window is closed."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # tables without a zone are in that of the session
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder, and read what it gave.

    State, offsets and results lie in the shared folder, so a lost executor
    costs a repeat of its tasks only.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/taleflow-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    keep(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
