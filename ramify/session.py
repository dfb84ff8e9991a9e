"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ramify", master: str | None = None, **conf: str) -> SparkSession:
    """conf: further settings, with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
