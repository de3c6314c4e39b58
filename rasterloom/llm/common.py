"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Above either of these a side of a join is never broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` does just that on ASCII texts, which are told by equal character
    and byte counts, and is far cheaper than ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return base if ":" in base.split("/")[0] else f"file://{base}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/rasterloom-{name}-{uuid.uuid4().hex}"


#: Tasks that files are dealt to at most; each then takes several.
MOST_TASKS = 20_000

#: Rows that go to a Python worker at once while we write: texts are long.
BATCH_ROWS = "1000"


def materialize(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_dir`` named, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that are written, read back, and deleted at the end of a ``with`` block: nothing that reads them may leave it unwritten."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []
        self.tables: dict[str, tuple[SparkSession, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.tables):
            self.release(name)
        for spark, path in self.held:
            drop_written(spark, path)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = fresh_dir(df.sparkSession, name)
        self.held.append((df.sparkSession, path))
        return materialize(df, name, codec, path)

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int, by: str | None = None) -> str:
        """The name of a table dealt by ``column``, so that a join on it needn't move these rows; ``by``: a column of few values, a folder each."""
        spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        self.tables[table] = spark, path
        write = df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column)
        (write.partitionBy(by) if by else write).saveAsTable(table)
        return table

    def release(self, table: str) -> None:
        spark, path = self.tables.pop(table)
        spark.sql(f"drop table if exists {table}")
        drop_written(spark, path)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark deletes shuffle files once nothing there refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """A name made from ``name`` that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only for a counted size within the bounds; else leave the join to a shuffle."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def give_back() -> None:
    """Return what a Python worker has freed to the system; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: bounds what a Python worker holds as objects at once."""
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        give_back()
