"""Ranks over a whole table, range by range, so that no task holds more than one range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from evspark.llm.common import written


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `rank` (1, 2, 3...) in ascending order of the columns `order`, which should tell all rows apart.

    Each range of keys is sorted and counted by its task; the number of ranges, and with it the table of their sizes that is
    broadcast, is that of the session's shuffle partitions at most. rows should be a written table: it is read twice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            made = [pa.array([part] * n, pa.int32()), pa.array(range(k + 1, k + n + 1), pa.int64())]
            k += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_part", "_k"])

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_k", LongType())])
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), "ranges")
    sizes = parts.groupBy("_part").agg(F.max("_k").alias("_n"))  # a row for each range
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")
