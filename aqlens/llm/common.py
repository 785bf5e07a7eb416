"""Shared helpers: tables of the driver, written intermediate tables, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens.session import scratch_path

# Rows that a Python task turns into one Arrow batch at a time: the batch ends
# earlier once its payload reaches FLUSH_BYTES, so long texts don't pile up.
FLUSH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back.

    The written table cuts the lineage: what follows survives lost executors
    without computing ``df`` again, and joins on it plan an exchange of their
    own, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # an empty table has no files to read the schema from
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a written table of at most ``most`` rows; a larger one is left
    to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def remove(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def released(run: Callable) -> Callable:
    """A task over batches that gives freed memory back to the system when it
    ends: workers live on, and what their allocators keep adds up."""

    def task(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, **options)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return task


def slices(batch: pa.RecordBatch, column: int, limit: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` bytes of a binary column."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        base, start = int(total[end - 1]), end
