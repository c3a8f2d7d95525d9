"""Session construction for local runs, tests and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def outer_session(app: str = "tilmark") -> SparkSession:
    """The session of whoever calls: an active one, or that of spark-submit with its master; else a local one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        return SparkSession.builder.appName(app).getOrCreate()
    return local_session(app=app)


def local_session(cores: int | str | None = None, app: str = "tilmark", driver_memory: str = "6g", **extra) -> SparkSession:
    """A local session with the settings that results depend on (UTC, adaptive execution)."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
