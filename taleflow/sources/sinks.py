"""Sinks: partitioned Parquet, score and metadata CSV, sentence text, vocabulary JSON."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audio import encode_wav


def write_dataset(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """One folder per split, files of bounded size."""
    df.write.mode("overwrite").partitionBy("split").option("maxRecordsPerFile", max_records).parquet(path)


def score_file_name(model: str, dataset: str, no_lm: bool = False) -> str:
    clean = lambda x: re.sub(r"::|\.", "-", x.replace("/", "--"))
    return f"{clean(model)}{'-no-lm' if no_lm else ''}.{clean(dataset)}.csv"


def write_scores(scores: DataFrame, path: str) -> None:
    """A score cube is small: one CSV file with header."""
    scores.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_metadata(df: DataFrame, path: str) -> None:
    """Metadata of a data set as CSV files with header, one per task."""
    df.write.mode("overwrite").csv(path, header=True)


def write_clips(df: DataFrame, folder: str, name: str = "name", array: str = "array", rate: int = 16_000) -> None:
    """One WAV file per row in a folder that all executors share; a clip written twice replaces itself."""
    encoded = df.select(name, encode_wav(rate)(array).alias("__wav")).filter(F.col("__wav").isNotNull())

    def write(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        n = 0
        for batch in batches:
            for stem, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # whole or not at all, also where a task is run twice
                part = os.path.join(folder, f".{stem}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, f"{stem}.wav"))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    encoded.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_sentences(df: DataFrame, text: str, path: str) -> None:
    df.select(text).write.mode("overwrite").text(path)


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """The vocabulary (an alphabet) as one JSON object from character to index."""
    pairs = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "char"))).alias("p"))
    return pairs.select(F.to_json(F.map_from_arrays(F.col("p.char"), F.col("p.id"))).alias("json"))
