"""A Spark session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive plans with skew handling; settings are given with dots as double underscores."""
    builder = SparkSession.builder.appName("quernstone")
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    for key, value in (conf | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
