"""Sources: CSV, TSV, text lines, whole texts, files, subtitles, waveforms."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.audio import decode_wav
from ..functions.text import parse_dataset_name, strip
from ..plans.prefix import dense_numbers


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def read_splits_tsv(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Tab-separated files of several splits in one table with a split column."""
    out = None
    for split, path in paths.items():
        df = read_csv(spark, path, schema, "\t").withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of one file with dense numbers from 1: line_no, line."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    return dense_numbers(lines, "__block", "__id", "line_no").select("line_no", "line")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: stem, text and the path of the recording beside it."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select(stem(F.col("path")).alias("stem"), F.col("value").alias("text"), F.regexp_replace("path", r"\.txt$", ".wav").alias("audio_path"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    """All suffixes of a file name: ``.tar.gz``."""
    return F.regexp_extract(path, r"((?:\.[^./]+)*)$", 1)


def list_files(spark: SparkSession, folder: str, extension: str = "wav") -> DataFrame:
    """Path, stem and length of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(folder)
    return df.select("path", stem(F.col("path")).alias("stem"), "length")


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded waveforms: stem, array, sampling_rate, error."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return df.select(stem(F.col("path")).alias("stem"), decode_wav("content").alias("a")).select("stem", "a.*")


def path_parts(path: Column) -> dict[str, Column]:
    """split (the folder train, val or test, lower case), stem and all suffixes of a file's path in an unpacked archive."""
    folder = F.lower(F.regexp_extract(path, r"(?i)/(train|val|test)[^/]*/(?:.*/)?[^/]*$", 1))
    return {"split": F.nullif(folder, F.lit("")), "stem": F.regexp_extract(path, r"([^/.][^/.]*)[^/]*$", 1), "suffix": suffix(path)}


def read_sql(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """A SQL text over the Parquet tables of a folder, each a temporary view of its name."""
    fs = spark._jvm.org.apache.hadoop.fs
    base = fs.Path(folder)
    for status in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder.rstrip('/')}/{name}").createOrReplaceTempView(name.removesuffix(".parquet"))
    return spark.sql(query)


def cached(spark: SparkSession, root: str, inputs: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored result, built and written on the first use: keyed by a hash of all inputs, so no other result can be taken for it.

    ``inputs`` names everything the result depends on (data set, subset,
    revision, split, filters, cleaner, ...), as JSON values or as what their
    ``repr`` says. A result that was only written in part is built again.
    """
    key = hashlib.md5(json.dumps(inputs, sort_keys=True, default=repr).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{key}"
    fs = spark._jvm.org.apache.hadoop.fs
    done = fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_dataset(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """A data set by ``id[::subset][@revision]`` below ``root``; falls back to split train, then to the whole folder."""
    ident, subset, revision = parse_dataset_name(name)
    base = "/".join(x for x in (root.rstrip("/"), ident, subset, revision) if x)
    fs = spark._jvm.org.apache.hadoop.fs
    for path in (f"{base}/{split}", f"{base}/train", base):
        p = fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path)
    raise FileNotFoundError(base)


def _clock_ms(c: Column) -> Column:
    p = F.split(c, "[:.]")
    n = lambda i: F.get(p, i).try_cast("int")
    return ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + n(3) * 10


def subtitle_events(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Dialogue events of ASS texts: the keys, event_no, start_ms, end_ms, name, text."""
    lines = df.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("event_no", "line")).filter(F.col("line").startswith("Dialogue:"))
    f = F.split("line", ",", 10)
    return lines.select(*keys, "event_no", _clock_ms(F.get(f, 1)).alias("start_ms"), _clock_ms(F.get(f, 2)).alias("end_ms"), F.get(f, 4).alias("name"), F.get(f, 9).alias("text"))


def last_listed(files: DataFrame) -> DataFrame:
    """One file per stem; of several the last by path."""
    w = Window.partitionBy("stem").orderBy(F.desc("path"))
    return files.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
