"""Streams of events: idempotent merges, sessions and daily counts with lateness."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.table import Table
from .batches import Batches

LATENESS = "3 days"


def source(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files below a path as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    folder, glob = (os.path.dirname(path), os.path.basename(path)) if path.endswith(".parquet") and not _is_folder(spark, path) else (path, "*.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def merge_stream(spark: SparkSession, path: str, table: str, checkpoint: str, key: list[str], bounded_by: str | None = None) -> int:
    """Merge all that is there into a table, each key once, and stop. Batches that are played again insert nothing. bounded_by: a column that follows from the key; a batch then meets only files with its range."""

    def put(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        Table(batch.sparkSession, table).merge_insert(held, key, [bounded_by] if bounded_by else None, bounded_by)
        held.unpersist()

    q = source(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return Table(spark, table).version()


def deduplicated(events: DataFrame, key: str = "event_key", at: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """A stream without repeated keys within the lateness."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, at: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """Counts by day and type; on a stream a day is final when the watermark has passed it."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.window(at, "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", at: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """Sessions by Spark's session windows, in batch and on streams alike: user_id, started and n."""
    kind = events.schema[at].dataType
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(at, lateness)
    return rows.groupBy(F.session_window(at, gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast(kind).alias("started"), "n")


def session_stream(spark: SparkSession, path: str, table: str, checkpoint: str, name: str = "sessions", files_per_batch: int = 1000, lateness: str = LATENESS) -> Table:
    """Sessions of the event files below a path, appended to a table when they are over: all that is there, then stop.

    Events may come in any order within the lateness. An open session is state; an event between two of
    them makes them one. A session is written once the watermark of the batch before has passed its end, so
    the last ones wait for later events, such as heartbeats without a user; each is written once, also where
    a batch is played again.
    """
    batches, target = Batches(Table(spark, f"{table}_batches"), name), Table(spark, table)

    def put(batch: DataFrame, n: int) -> None:
        if not batches.done(n):  # rows without a user only move the time on; dropped in the query itself, they would not
            batches.mark(n, batches.append_once(target, batch.filter("user_id IS NOT NULL"), n))

    q = session_windows(source(spark, path, files_per_batch), lateness=lateness).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return target
