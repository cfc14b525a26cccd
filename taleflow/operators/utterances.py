"""Utterance identifiers and their recording files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import periods_and_gaps


def id_parts(utterance_id: Column) -> Column:
    """The parts of ``<speaker>_<year+digit>_<code>_<n>`` in upper case, whatever case, blanks and separators were used."""
    bare = F.upper(F.regexp_replace(utterance_id, "(?U)\\s+", ""))
    return F.split(F.regexp_replace(bare, "[-_]+", "_"), "_")


def recording_file(utterance_id: Column) -> Column:
    """``<year+digit>_<code>`` of an utterance id; null where the id has fewer than three parts."""
    parts = id_parts(utterance_id)
    return F.when(F.size(parts) >= 3, F.concat_ws("_", F.get(parts, 1), F.get(parts, 2)))


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds; null for null, NaN and infinite values."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9.0e15)
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def file_periods(utterances: DataFrame) -> DataFrame:
    """Covered periods and gaps of each recording file: src_fname, kind, start_ms, end_ms."""
    spans = utterances.select(
        recording_file(F.col("utterance_id")).alias("src_fname"),
        F.when(~F.isnan("start_time"), F.col("start_time")).alias("s"),
        F.when(~F.isnan("end_time"), F.col("end_time")).alias("e"),
    ).select("src_fname", to_ms(F.col("s")).alias("s"), to_ms(F.col("e")).alias("e"))
    out = periods_and_gaps(spans, "src_fname", "s", "e")
    return out.withColumnRenamed("entity", "src_fname")
