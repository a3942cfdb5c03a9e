"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidewind", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI errors stay on."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
