"""Waveforms as arrays: normalisation, slicing, padding, decoding."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType

_DECODED = StructType().add("array", ArrayType(FloatType())).add("sampling_rate", IntegerType()).add("error", StringType())


def peak_normalise(a: Column) -> Column:
    """Scaled so that the greatest magnitude is 1; silence stays as it is."""
    peak = F.array_max(F.transform(a, F.abs))
    return F.when(peak > 0, F.transform(a, lambda x: x / peak)).otherwise(a)


def duration(a: Column, rate: int | Column) -> Column:
    """Seconds."""
    return F.size(a) / rate


def time_slice(a: Column, start_ms: int | Column, end_ms: int | Column, rate: int) -> Column:
    """The samples of [start_ms, end_ms)."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start_ms, end_ms))
    first = F.floor(start * rate / 1000).cast("int")
    return F.slice(a, first + 1, F.greatest(F.floor(end * rate / 1000).cast("int") - first, F.lit(0)))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def pad_to(a: Column, length: Column, value) -> Column:
    """Padded on the right to ``length``; longer arrays stay."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(length - F.size(a), F.lit(0))))


def argmax(steps: Column) -> Column:
    """Index of the first greatest score of every step."""
    return F.transform(steps, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


@F.pandas_udf(_DECODED)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """Samples in [-1, 1] (channels averaged) of PCM WAV bytes; what cannot be decoded has an error."""
    rows = []
    for c in content:
        try:
            with wave.open(io.BytesIO(c)) as w:
                width, kind = w.getsampwidth(), {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
                x = np.frombuffer(w.readframes(w.getnframes()), dtype=kind).astype(np.float32)
                x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
                rows.append((x.reshape(-1, w.getnchannels()).mean(axis=1).tolist(), w.getframerate(), None))
        except Exception as e:
            rows.append((None, None, type(e).__name__))
    return pd.DataFrame(rows, columns=["array", "sampling_rate", "error"])


def resampler(rate: int):
    """A pandas UDF: linear resampling of (array, sampling rate) to ``rate``."""

    @F.pandas_udf("array<float>")
    def resample(a: pd.Series, old: pd.Series) -> pd.Series:
        def one(x, r):
            if x is None or not len(x) or r is None:
                return x
            n = int(round(len(x) * rate / r))
            return np.interp(np.arange(n) * r / rate, np.arange(len(x)), x).astype(np.float32)

        return pd.Series([one(x, r) for x, r in zip(a, old)])

    return resample


def encode_wav(rate: int):
    """A pandas UDF: 16-bit mono WAV bytes of samples in [-1, 1]; null stays null."""

    @F.pandas_udf("binary")
    def encode(a: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                w.writeframes(np.clip(np.round(np.asarray(x, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
            return out.getvalue()

        return pd.Series([one(x) for x in a], dtype=object)

    return encode


def hours(a: Column, rate: int) -> Column:
    """Aggregate: total hours of waveforms, their samples over the rate."""
    return F.sum(F.size(a).cast("long")) / F.lit(rate * 3600.0)


def samples_of_hours(n_hours: Column | float, mean_seconds: Column | float) -> Column:
    """How many samples of a mean length make up so many hours, rounded down."""
    h, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in (n_hours, mean_seconds))
    return F.floor(h * 3600 / m).cast("long")


#: Kinds of coloured noise with the power of the frequency that their power spectrum follows.
COLOURS = {"white": 0.0, "pink": -1.0, "brown": -2.0, "blue": 1.0, "violet": 2.0}
FILTERS = ("low", "high", "band", "stop")


def _coloured(n: int, power: float, rng: np.random.Generator) -> np.ndarray:
    spectrum = np.fft.rfft(rng.normal(size=n))
    f = np.arange(len(spectrum), dtype=np.float64)
    f[0] = 1.0
    x = np.fft.irfft(spectrum * f ** (power / 2), n)
    top = np.abs(x).max()
    return x / top if top else x


def _filtered(x: np.ndarray, kind: str, low: float, high: float) -> np.ndarray:
    """Frequencies outside the pass (or inside the stop) removed; cut-offs as shares of half the sampling rate."""
    spectrum = np.fft.rfft(x)
    f = np.linspace(0, 1, len(spectrum))
    keep = {"low": f <= high, "high": f >= low, "band": (f >= low) & (f <= high), "stop": (f < low) | (f > high)}[kind]
    return np.fft.irfft(spectrum * keep, len(x))


def augment_array(x, rng: np.random.Generator, background=None, gain_db: float = 6.0, background_p: float = 0.7, noise_p: float = 0.2, filter_p: float = 0.2) -> np.ndarray:
    """Peak normalisation and gain always; background, coloured noise and one of four filters each with its probability."""
    y = np.asarray(x, np.float64)
    if not len(y):
        return y.astype(np.float32)
    peak = np.abs(y).max()
    y = y / peak if peak else y
    y = y * 10 ** (rng.uniform(-gain_db, gain_db) / 20)
    draws = rng.random(3)
    if background is not None and len(background) and draws[0] < background_p:
        b = np.resize(np.roll(np.asarray(background, np.float64), rng.integers(len(background))), len(y))
        top = np.abs(b).max()
        y = y + (b / top if top else b) * 10 ** (-rng.uniform(3, 30) / 20)
    if draws[1] < noise_p:
        y = y + _coloured(len(y), rng.choice(list(COLOURS.values())), rng) * 10 ** (-rng.uniform(10, 40) / 20)
    if draws[2] < filter_p:
        low = rng.uniform(0.01, 0.3)
        y = _filtered(y, str(rng.choice(FILTERS)), low, min(low + rng.uniform(0.2, 0.6), 1.0))
    return y.astype(np.float32)


def augmenter(seed: int, **options):
    """A pandas UDF of (array, integer key, background array or null): reproducible per seed and key; null stays null."""

    @F.pandas_udf("array<float>")
    def augment(a: pd.Series, key: pd.Series, background: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else augment_array(x, np.random.default_rng([seed, int(k) & 0xFFFFFFFF]), b, **options) for x, k, b in zip(a, key, background)], dtype=object)

    return augment
