"""Session defaults. Jobs on a cluster pass their own session; nothing here is required by the operators."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution, UTC and as many shuffle partitions as cores."""
    n = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("sparkarch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
