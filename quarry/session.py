"""A session with the settings the engine expects, for programs that don't bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """Get or make a session: UTC, adaptive execution, skew joins, and no guess at the size of the cluster."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
