"""A Spark session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sqlassay", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, ANSI arithmetic, UTC; ``conf`` adds to or replaces these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
