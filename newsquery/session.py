"""The session that the engine expects; any session with these settings will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "newsquery", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; cluster sizes are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
