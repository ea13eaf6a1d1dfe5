"""Incremental ingest: new texts of a stream join an index once, by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions import text as T
from pagewright.operators import store


def new_texts(batch: DataFrame, index: DataFrame | None) -> DataFrame:
    """(hash, text) of the batch's distinct texts that the index (hash) does not have."""
    if index is None:
        return batch.select("text").distinct().select(T.content_hash(F.col("text"), 32).alias("hash"), "text")
    return store.cache_misses(batch, index).select("hash", "text")


def start(stream: DataFrame, index_path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append the stream's new texts, with what ``embed`` adds, to the index at ``index_path``.

    A batch that is repeated after a failure finds its texts there and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = new_texts(batch.filter("text is not null"), _index(spark, index_path))
        (embed(found) if embed else found).write.mode("append").parquet(index_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) by window; rows later than ``late`` are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
