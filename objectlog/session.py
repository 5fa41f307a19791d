"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "objectlog", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; further settings with _ for the dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
