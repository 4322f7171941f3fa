"""What the corpus operators share: input tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset in a local run."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(set_to)
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so that a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def named(column: str) -> Column:
    """A column by its name as it is, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def with_made(docs: DataFrame, keep: list[str], made: str) -> StructType:
    """The schema of the columns `keep` of docs and then those of the DDL string `made`."""
    return StructType([docs.schema[c] for c in keep] + StructType.fromDDL(made).fields)


class Chunks:
    """Arrow files of a folder that all executors reach."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.files, self.path = FileSystem.from_uri(folder)

    def write(self, rows: list[pa.RecordBatch], schema: pa.Schema) -> int:
        chunk = uuid.uuid4().int >> 65
        self.files.create_dir(self.path, recursive=True)
        with self.files.open_output_stream(f"{self.path}/{chunk}.arrow") as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for x in rows:
                stream.write_batch(x)
        return chunk

    def read(self, chunk: int) -> pa.Table:
        with self.files.open_input_stream(f"{self.path}/{chunk}.arrow") as f:
            return pa.ipc.open_stream(f).read_all().combine_chunks()


def tidy() -> None:
    """Gives freed memory back to the system at the end of a task, as a Python worker lives on beside its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
