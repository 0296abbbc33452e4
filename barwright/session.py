"""Spark session for scripts, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "barwright", cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions.

    On a cluster the session comes from the submit command and none of this applies.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
