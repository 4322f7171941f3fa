"""Session factory used by tests, benchmarks and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "evspark", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings given by spark-submit are kept."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
