"""A Spark session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "snpweave", **conf: str) -> SparkSession:
    """AQE with skew joins, UTC, ANSI; further settings override these."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
