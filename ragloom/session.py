"""A session with the settings the jobs expect; on a cluster, submit-time settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ragloom", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
