"""Raw files as a stream: to Bronze and quarantine, and on to Silver and the daily mart.

Spark's file source keeps its own log of the files it has read, so a landing lists what is new and opens
nothing else; no commit needs to name files. Every micro-batch is written once (see ``batches``).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lake import CRASH, Lake
from ..sources import raw
from .batches import Batches


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, schema: T.StructType = raw.EVENT_SCHEMA) -> DataFrame:
    """The rows of CSV files below a folder, those that don't parse too, with ``source_file``."""
    declared = T.StructType([*schema.fields, T.StructField(raw.CORRUPT, T.StringType(), True)])
    reader = spark.readStream.schema(declared).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw.CORRUPT)
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias("source_file"))


def _run(rows: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def land(lake: Lake, path: str, now: datetime, name: str = "landing", files_per_batch: int = 1000) -> dict:
    """Land all files that are there and not yet landed, then stop: valid rows go to Bronze with their lineage, others to ``quarantine/batch_id=NAME-N``. Returns the rows of this start; valid and quarantined add up to all."""
    told = {"rows": 0, "valid": 0, "quarantined": 0}
    batches, bronze = Batches(lake.table("stream_batches"), name), lake.table("bronze")

    def put(batch: DataFrame, n: int) -> None:
        if batches.done(n):
            return
        batch_id = f"{name}-{n}"
        valid, bad, counts = raw.split_corrupt(batch)
        raw.write_quarantine(bad, f"{lake.root}/quarantine", batch_id)
        stamped = raw.stamp_lineage(valid.withColumnRenamed("source_file", "_file"), batch_id, now, "").withColumn("source_file", F.col("_file")).drop("_file")
        version = batches.append_once(bronze, stamped, n, ["event_date"])
        batches.mark(n, version)
        batch.unpersist()
        for k in told:
            told[k] += counts[k]

    _run(raw_stream(lake.spark, path, files_per_batch), put, f"{lake.root}/checkpoints/{name}")
    return told


def marts(lake: Lake, events: DataFrame, now: datetime, name: str = "marts") -> int:
    """A stream of Bronze rows to Silver and the daily mart, all that is there, then stop; returns the rows merged.

    A batch merges its events by key and brings the mart up to Silver's last commit, however late its
    events are. One that is played again inserts nothing, and the mart follows Silver's commits, not
    batches: a run that was killed between the two is made good by its next batch.
    """
    merged, batches = [0], Batches(lake.table("stream_batches"), name)

    def put(batch: DataFrame, n: int) -> None:
        if batches.done(n):
            return
        merged[0] += lake.merge(batch, now)["inserted"]
        if any(os.environ.get(v, "").lower() == "between" for v in CRASH):
            raise RuntimeError("crash asked for between the two writes")
        lake.rebuild_daily(now)
        batches.mark(n)

    _run(events, put, f"{lake.root}/checkpoints/{name}")
    return merged[0]


def bronze_stream(lake: Lake, files_per_batch: int = 1000) -> DataFrame:
    """The files of Bronze as a stream, each once."""
    bronze = lake.table("bronze")
    return lake.spark.readStream.schema(bronze.schema()).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{bronze.path}/data")
