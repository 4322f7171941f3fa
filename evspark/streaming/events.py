"""Structured Streaming over files of events: windows with watermarks, sessions, and mastery kept for each learner.

Each function takes a streaming DataFrame with `ts` as timestamp and gives one; `drained` runs such a query over all that
is there and gives its result as a table, for tests and batch comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evspark.sources.stored import new_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{sf_dir}/events.parquet*"  # one file, or the files of a folder
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over all that is available now, as a table in the shared folder, beside the query's progress.
    A batch that runs again overwrites its own rows. In complete mode the last batch counts, else all rows do."""
    spark, folder = stream.sparkSession, new_path(stream.sparkSession, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-progress").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    done = [p["batchId"] for p in running.recentProgress]
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(folder)
    return (rows.filter(F.col("batch") == max(done)) if mode == "complete" else rows).drop("batch")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


class Mastery(StatefulProcessor):
    """Knowledge tracing for each learner: the state is a probability and a count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mastery", StructType([StructField("p", DoubleType()), StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        p, n = self.state.get() if self.state.exists() else (0.30, 0)
        seen = pd.concat(rows).sort_values("event_id")
        for right in seen["correct"]:
            if right:
                p = p * 0.9 / (p * 0.9 + (1 - p) * 0.2)
                p += (1 - p) * 0.2
            else:
                p = p * 0.1 / (p * 0.1 + (1 - p) * 0.8)
            p, n = min(0.999, max(0.001, p)), n + 1
        self.state.update((p, n))
        yield pd.DataFrame({"user_id": [key[0]], "mastery": [p], "n": [n]})

    def close(self) -> None:
        pass


def mastery_stream(events: DataFrame) -> DataFrame:
    """user_id, mastery, n after each batch's answers: purchase is a correct answer, error a wrong one."""
    answers = events.filter(F.col("event_type").isin("purchase", "error")).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("correct"))
    out = StructType([StructField("user_id", LongType()), StructField("mastery", DoubleType()), StructField("n", LongType())])
    return answers.groupBy("user_id").transformWithStateInPandas(Mastery(), out, "Update", "None")
