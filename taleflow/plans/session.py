"""Session construction for tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "taleflow", cores: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is developed under.

    On a cluster the session comes from the submitter; nothing in the package
    depends on the values set here.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
