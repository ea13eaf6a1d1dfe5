"""What the training-data operators share: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows below which a lookup table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the filter that spares most rows a shuffle: 2**24 bits are 2 MB, whatever the input.
FILTER_BITS = 24


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Lists of the tables that ``cut`` has written, of those who asked for one.
_recorded: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a folder of our own, but only in local mode: on a
    cluster other executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "pagewright-scratch")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: what follows survives lost executors without repeating what came before. Tables stay
    until ``clear_scratch`` as a lazily evaluated result may still read them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    for made in _recorded:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The tables that ``cut`` writes meanwhile."""
    made: list[str] = []
    _recorded.append(made)
    try:
        yield made
    finally:
        _recorded.remove(made)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables of ``cut``, once whatever reads them has been written."""
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``cut`` has left. Call it when no result is waiting to be read."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pagewright-*")) or []:
        fs.delete(status.getPath(), True)


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join with a lookup table: broadcast if it has at most ``BROADCAST_ROWS`` rows, else a shuffled join,
    whose hot keys adaptive execution splits."""
    n = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def give_back() -> None:
    """Return freed memory of this worker process to the system: workers stay for later tasks, and what they have freed
    but kept counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_freed() -> None:
    """Have this worker process use freed memory of arrays again, rather than return and fetch it, zeroed, each time."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        tune(-3, 16 << 20)  # blocks up to this size are not mapped apart
        tune(-1, 64 << 20)  # freed memory that a process keeps until it is trimmed


def trimmed(run: Batches) -> Batches:
    """``run``, a function of Arrow batches, that gives back memory at its end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, where repeating it would evaluate it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)) + 1


def maybe(docs: DataFrame, keys: DataFrame, inside: bool = True, key: str = "tid") -> DataFrame:
    """The rows of ``docs`` whose ``key`` may be among those of ``keys`` (or surely is not): a filter of fixed size,
    broadcast."""
    bits = keys.select(F.bitmap_bucket_number(_bit(F.col(key))).alias("pw_bucket"), F.bitmap_bit_position(_bit(F.col(key))).alias("pw_pos"))
    bits = bits.groupBy("pw_bucket").agg(F.bitmap_construct_agg("pw_pos").alias("pw_bits"))
    place = F.bitmap_bit_position(_bit(F.col(key)))
    joined = docs.withColumn("pw_bucket", F.bitmap_bucket_number(_bit(F.col(key)))).join(F.broadcast(bits), "pw_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("pw_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return joined.filter(there if inside else ~there).select(*docs.columns)
