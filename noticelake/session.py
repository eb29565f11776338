"""Spark session settings shared by the entry module, the bench and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the time zone and Arrow settings the queries expect."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("noticelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: that of spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place, but only for a local master; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set")
        base = tempfile.mkdtemp(prefix="noticelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
