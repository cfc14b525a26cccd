"""Cutting lineage through written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (local runs), one of our own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="taleflow-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Columnar and compressed, hence smaller than a checkpoint and prunable. The
    table is removed with :func:`release`, on leaving :func:`scratch`, or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/taleflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._taleflow_path = path
    return out


def keep(spark: SparkSession, path: str) -> None:
    """Take charge of a folder written elsewhere, as if by :func:`materialise`."""
    _WRITTEN[path] = spark


def drop(path: str) -> None:
    """Delete a table of :func:`materialise`."""
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` whose rows are no longer needed by any plan."""
    for t in tables:
        drop(getattr(t, "_taleflow_path", ""))


@contextmanager
def scratch() -> Iterator[None]:
    """Delete on leaving every table written inside; results must have been written or collected by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            drop(path)


@atexit.register
def drop_all() -> None:
    for path in list(_WRITTEN):
        drop(path)
