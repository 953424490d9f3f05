"""Spark sessions for local runs; on a cluster the session comes with its own settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


#: Spark 4.1 lets a union keep the partitioning that its inputs share, and then pairs their partitions by number, though adaptive execution
#: may have given them different ones: keys are parted, or the query ends with "Can't zip RDDs".
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def steady(spark: SparkSession) -> SparkSession:
    """The session with the settings that right results need; all others are its own."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    shared = os.path.join(tempfile.gettempdir(), "siltstone")
    return steady(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .getOrCreate()
    )
