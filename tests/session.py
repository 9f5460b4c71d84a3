from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def new_session() -> SparkSession:
    """A small local session; the shared folder is a fresh one. Local workers share the cores, so each does its algebra in one thread."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spreadrank")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
