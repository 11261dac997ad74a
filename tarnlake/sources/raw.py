"""The raw zone: CSV files under ``ingested_date=`` folders, their quarantine and their listing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("category_id", T.LongType(), False),
        T.StructField("category_code", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", T.DoubleType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_session", T.StringType(), False),
    ]
)
CORRUPT = "_corrupt_record"
ZONES = ("raw", "bronze", "silver", "gold", "reference", "logs")


def files(spark: SparkSession, path: str) -> list[str]:
    """The CSV files that a path (a file, a folder with partitions, or a pattern) names, found by listing alone."""
    fs, p = store.at(spark, path)
    out = []
    for status in fs.globStatus(p) or []:
        if status.isFile():
            out.append(status.getPath().toString())
            continue
        walk = fs.listFiles(status.getPath(), True)
        while walk.hasNext():
            name = walk.next().getPath()
            parts = name.toUri().getPath().removeprefix(status.getPath().toUri().getPath()).split("/")
            if not any(x.startswith(("_", ".")) for x in parts):
                out.append(name.toString())
    return out


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Typed rows; a row that does not parse keeps its line in ``_corrupt_record``."""
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return spark.read.schema(declared).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def rows_of(spark: SparkSession, files: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """file and n, the rows of each CSV file of a column of ``_metadata.file_path`` values.

    Only the names of their folders come to the driver; files lie there that are not asked for, and these are
    told apart after counting. A file that is gone has no row.
    """
    own = files.toDF("file").filter("file IS NOT NULL").distinct()
    name = F.url_decode(F.replace(F.regexp_replace("file", "/[^/]*$", ""), F.lit("+"), F.lit("%2B")))  # these values are encoded
    kept: set[str] = set()
    for r in own.select(name.alias("f")).distinct().orderBy("f").collect():
        parts = r["f"].split("/")
        if not kept.intersection("/".join(parts[:i]) for i in range(1, len(parts))):  # else read with the folder above
            kept.add(r["f"])
    if not kept:
        return spark.createDataFrame([], "file string, n long")
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    rows = spark.read.schema(declared).option("header", True).option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).csv(sorted(kept))
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).join(own, "file", "left_semi")


def split_corrupt(raw: DataFrame, required: tuple[str, ...] = ("event_time", "event_type", "product_id", "user_id")) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(valid, quarantine, counts) from one stored scan. Rows that do not parse, or lack a required value, are quarantined; both counts add up to all rows."""
    held = raw.persist(StorageLevel.MEMORY_AND_DISK)
    bad = F.col(CORRUPT).isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    n = held.agg(F.count("*").alias("rows"), F.count_if(bad).alias("quarantined")).first()
    counts = {"rows": n["rows"], "valid": n["rows"] - n["quarantined"], "quarantined": n["quarantined"], "quarantine_pct": round(100 * n["quarantined"] / n["rows"], 4) if n["rows"] else 0.0}
    return held.filter(~bad).drop(CORRUPT), held.filter(bad), counts


def write_quarantine(bad: DataFrame, folder: str, batch_id: str) -> str | None:
    """Parquet beneath ``batch_id=``; nothing where there are no rows."""
    if bad.isEmpty():
        return None
    target = f"{folder}/batch_id={batch_id}"
    bad.write.mode("overwrite").parquet(target)
    return target


def stamp_lineage(df: DataFrame, batch_id: str, ingested_at: datetime, source: str | None = None) -> DataFrame:
    """Adds ingested_at, source_file, pipeline_run_id, batch_id and event_date."""
    file = F.col("_metadata.file_path") if source is None else F.lit(source)
    return df.withColumns({
        "ingested_at": F.lit(ingested_at), "source_file": file, "pipeline_run_id": F.lit(batch_id),
        "batch_id": F.lit(batch_id), "event_date": F.to_date("event_time"),
    })


def ingest(spark: SparkSession, files: list[str], raw: str, day: str | None = None, sleep: Callable = time.sleep) -> str:
    """Copy files, from whatever store, into ``ingested_date=``; the ``_SUCCESS`` marker is written after all of them."""
    folder = store.make(spark, f"{raw.rstrip('/')}/ingested_date={day or datetime.now(UTC).date().isoformat()}")
    name = lambda f: f.rstrip("/").rsplit("/", 1)[-1]
    for f in files:
        store.retrying(lambda f=f: store.copy(spark, f, f"{folder}/{name(f)}"), sleep=sleep)
    told = {"files": sorted(map(name, files)), "bytes": sum(store.size(spark, f"{folder}/{name(f)}") for f in files)}
    store.retrying(lambda: store.write(spark, f"{folder}/_SUCCESS", json.dumps(told)), sleep=sleep)
    return folder


def create_zones(spark: SparkSession, root: str) -> list[str]:
    """The folders of all zones."""
    return [store.make(spark, f"{root.rstrip('/')}/{z}") for z in ZONES]


def head_sample(spark: SparkSession, source: str, target: str, lines: int = 50_000) -> int:
    """The first lines, the header among them, from one file to another; the rest is not read."""
    found = store.lines(spark, source, lines)
    store.write(spark, target, "".join(f"{x}\n" for x in found))
    return len(found)


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modified and partition of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.regexp_extract("path", r"([a-z_]+=[^/]+)/[^/]*$", 1).alias("partition"))


def structural_checks(spark: SparkSession, folder: str, now: datetime, max_age_days: int = 30, min_bytes: int = 100_000, glob: str = "*.csv") -> list[dict]:
    """Five checks of a raw folder: it exists, has partitions, no empty files, is fresh, and large enough."""
    names = ("exists", "partitions", "non_empty", "fresh", "total_bytes")
    fs, path = store.at(spark, folder)
    if not fs.exists(path):
        return [{"check": n, "passed": False, "value": None} for n in names]
    r = listing(spark, folder, glob).agg(
        F.count("*").alias("files"), F.countDistinct(F.nullif("partition", F.lit(""))).alias("partitions"), F.count_if(F.col("length") == 0).alias("empty"),
        F.max("modified").alias("newest"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    ).first()
    age = (now.replace(tzinfo=None) - r["newest"]).total_seconds() / 86400 if r["newest"] else None
    return [
        {"check": "exists", "passed": True, "value": folder},
        {"check": "partitions", "passed": r["partitions"] > 0, "value": r["partitions"]},
        {"check": "non_empty", "passed": r["files"] > 0 and r["empty"] == 0, "value": r["empty"]},
        {"check": "fresh", "passed": age is not None and age <= max_age_days, "value": age},
        {"check": "total_bytes", "passed": r["bytes"] > min_bytes, "value": r["bytes"]},
    ]
