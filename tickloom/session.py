"""Session helper: settings that this engine is written for; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tickloom", **conf: str) -> SparkSession:
    """A session in UTC, with ANSI semantics and adaptive execution. conf overrides, with `__` for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
