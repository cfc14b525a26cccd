"""Sample filters; nulls are kept or dropped as stated, never by accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def within_duration(array: Column, rate: int, low: float, high: float) -> Column:
    """Both bounds exclusive."""
    n = F.size(array)
    return (n > rate * low) & (n < rate * high)


def has_text(text: Column) -> Column:
    return F.length(strip(text)) > 0


def none_of(c: Column, *values: str) -> Column:
    """True unless the value is one of ``values``; null is kept."""
    out = F.lit(True)
    for v in values:
        out = out & ~c.eqNullSafe(F.lit(v))
    return out


def filter_samples(df: DataFrame, text: str, array: str | None = None, rate: int = 16_000, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Duration, non-blank text and, where the column exists, not rejected."""
    p = has_text(F.col(text))
    if array:
        p = p & within_duration(F.col(array), rate, low, high)
    if "validated" in df.columns:
        p = p & none_of(F.col("validated"), "rejected")
    return df.filter(p)


def below_error(df: DataFrame, rate: str = "asr_cer", most: float = 0.6) -> DataFrame:
    """Strictly below; null is dropped."""
    return df.filter(F.col(rate) < most)


# Marks of a segment that cannot be used.
UNUSABLE = (r"\*\*\*(.*?)\*\*\*", r"\[(.*?)\]")


def usable_segment(text: Column) -> Column:
    """Not blank and without ``***...***`` or ``[...]`` marks."""
    out = has_text(text)
    for mark in UNUSABLE:
        out = out & ~text.rlike(mark)
    return out


def large_enough(df: DataFrame, size: str, stem: str, bad_prefixes: tuple[str, ...] = (), least: int = 8192) -> DataFrame:
    """Files of at least ``least`` bytes whose stem has none of the prefixes."""
    out = df.filter(F.col(size) >= least)
    for p in bad_prefixes:
        out = out.filter(~F.col(stem).startswith(p))
    return out
