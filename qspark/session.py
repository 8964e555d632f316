"""Session factory: the settings that the engine's semantics and its scaling rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "qspark", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on (coalescing, skew joins), UTC, Arrow; cluster sizes stay with the cluster's own configuration."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
