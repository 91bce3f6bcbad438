"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "taleweave", **options: str) -> SparkSession:
    """Adaptive execution with skew splitting, and times in UTC. On a cluster set ``spark.checkpoint.dir`` to a folder that all executors share."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(name).config(map=settings | options).getOrCreate()
