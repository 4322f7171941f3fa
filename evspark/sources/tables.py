"""Readers for the parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read lazily so that filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with `ts` as an instant (streams reject zone-less timestamps)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
