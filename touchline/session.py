"""A Spark session with the settings that the engine is written for, and tables that it stores for its plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "touchline", master: str | None = None, **more: str) -> SparkSession:
    """Build or get a session; ``more`` overrides settings, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir, a local one only where that is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'touchline-round-trips')}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written to a new shared folder once and read from there wherever a plan needs them."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
