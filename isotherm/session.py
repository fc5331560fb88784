"""A session with what the library relies on: UTC, adaptive execution, overwriting only the partitions that are written."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "isotherm", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"} | conf
    return builder.config(map=settings).getOrCreate()
