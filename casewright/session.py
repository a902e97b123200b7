"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "casewright", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, UTC and per-partition overwrite; ``conf`` keys use _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
