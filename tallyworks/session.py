"""SparkSession with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "tallyworks", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow on; what the caller or cluster sets wins."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
