"""Queries over the table layer, the registry and streams: each works in a folder of its own below the warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..sources.adapter import CLICKSTREAM_SQL, clickstream
from ..sources.partitions import Partitioned
from ..sources.table import Table
from ..streaming import events as streams
from ..streaming import landing as landings
from . import replay as replays
from .lake import Lake
from .models import build

PINNED = datetime(2024, 3, 1)


#: What the registry must come to: tests of each model, and what each model and dashboard needs.
TESTS = {"stg_events": 2, "stg_products": 1, "int_sessions": 2, "int_events_enriched": 1, "dim_date": 1, "dim_customer": 1, "dim_product": 2, "fact_events": 2, "fact_purchases": 1, "mart_customer_retention": 2, "mart_daily_summary": 1, "mart_category_performance": 2}
NEEDS = {
    "stg_products": "stg_events", "int_sessions": "stg_events", "int_events_enriched": "int_sessions stg_products", "dim_customer": "int_events_enriched", "dim_product": "int_events_enriched",
    "fact_events": "int_events_enriched dim_date dim_customer dim_product", "fact_purchases": "fact_events", "int_customer_month_activity": "fact_purchases dim_date",
    "mart_customer_retention": "int_customer_month_activity", "mart_daily_summary": "fact_events fact_purchases dim_product", "mart_category_performance": "fact_purchases dim_product",
    "sales_dashboard": "mart_daily_summary", "retention_dashboard": "mart_customer_retention", "category_dashboard": "mart_category_performance",
}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the checkpoint folder if the cluster names one, else in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping batches, the last one twice, merged by key."""
    e, t = _events(spark, sf_dir), Table(spark, scratch(spark))
    for batch in ("event_id % 4 IN (0, 1)", "event_id % 4 IN (1, 2)", "event_id % 4 IN (2, 3)", "event_id % 4 IN (2, 3)"):
        t.merge_insert(e.filter(batch), ["event_id"])
    return t.read()


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version before later commits."""
    e, t = _events(spark, sf_dir), Table(spark, scratch(spark))
    t.append(e.filter("event_id % 2 = 0"))
    t.append(e.filter("event_id % 2 = 1"))
    t.overwrite(t.read().filter("event_type = 'view'"))
    return t.read(version=0)


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = _events(spark, sf_dir), Table(spark, scratch(spark))
    t.append(e.filter("event_id % 2 = 0"))
    t.merge_insert(e, ["event_id"])
    t.optimize(["user_id", "ts"], files=4)
    return t.history().select("version", "operation", F.coalesce(F.expr("element_at(operation_metrics, 'num_inserted')"), F.lit("0")).cast("long").alias("inserted"))


def zorder_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a narrow range after a Z-order rewrite; only files whose ranges meet it are read."""
    t = Table(spark, scratch(spark))
    t.append(_events(spark, sf_dir))
    t.optimize(["user_id", "value"], files=8)
    return t.read(bounds={"user_id": (3, 8)}).select("event_id", "user_id", "value")


def replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts in which two days are replaced whole."""
    daily = lambda e: e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    e, t = _events(spark, sf_dir), Table(spark, scratch(spark))
    t.append(daily(e.filter("event_id % 2 = 0")))
    days = ["2024-01-05", "2024-01-06"]
    affected = spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
    t.replace_keys(daily(e.filter(F.to_date("ts").cast("string").isin(days))), ["day"], affected)
    return t.read()


def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark's own partitions, of which two are replaced and one is emptied."""
    daily = lambda e: e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    e = _events(spark, sf_dir)
    mart = Partitioned(spark, scratch(spark), "day", daily(e).schema)
    mart.replace(daily(e.filter("event_id % 2 = 0")))
    days = ["2024-01-05", "2024-01-06"]
    mart.replace(daily(e.filter(F.to_date("ts").cast("string").isin(days))), [*days, "2024-01-07"])
    return mart.read()


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state table that is overwritten from itself."""
    e, t = _events(spark, sf_dir), Table(spark, scratch(spark))
    newest = e.groupBy("event_type").agg(F.max("ts").alias("last_seen"))
    t.overwrite(newest.filter("event_type <> 'click'").withColumn("last_seen", F.expr("last_seen - INTERVAL 1 DAY")))
    t.overwrite(t.read().unionByName(newest).groupBy("event_type").agg(F.max("last_seen").alias("last_seen")))
    return t.read()


def model_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests of all models: violations are 0."""
    r = build(clickstream(spark, sf_dir))
    out = r.test(r.run(retries=0, materialise=lambda m, df: df.persist()))
    return spark.createDataFrame([(x["model"], x["test"], x["violations"]) for x in out], "model string, test int, violations long")


def lineage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = build(clickstream(spark, sf_dir)).graph()
    return spark.createDataFrame([(x["source"], x["target"]) for x in g["links"]], "source string, target string")


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, merged by key in micro-batches; a second start finds nothing new."""
    root = scratch(spark)
    for _ in range(2):
        streams.merge_stream(spark, f"{sf_dir}/events.parquet", f"{root}/t", f"{root}/c", ["event_id"], bounded_by="event_id")
    return Table(spark, f"{root}/t").read().select("event_id", "user_id", "event_type", "value")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of event files that arrive up to two days late and out of order; heartbeats close the last sessions."""
    root, e = scratch(spark), clickstream(spark, sf_dir).select("user_id", F.col("event_time").cast("timestamp").alias("event_time"), "event_id")
    arrival = F.unix_date(F.to_date("event_time")) + F.pmod(F.xxhash64("event_id"), F.lit(3))
    rows = e.withColumn("part", F.floor(arrival / 5)).persist()
    for part in sorted(r[0] for r in rows.select("part").distinct().collect()):
        rows.filter(F.col("part") == part).select("user_id", "event_time").coalesce(1).write.mode("append").parquet(f"{root}/in")
    for day in (1, 2):
        spark.sql(f"SELECT CAST(NULL AS BIGINT) AS user_id, TIMESTAMP '2030-01-0{day}' AS event_time").write.mode("append").parquet(f"{root}/in")
    rows.unpersist()
    found = streams.session_stream(spark, f"{root}/in", f"{root}/out", f"{root}/c", files_per_batch=1).read()
    return found.withColumn("started", F.col("started").cast("timestamp_ntz"))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stage_events(clickstream(spark, sf_dir)).drop("user_session")


def rebuild_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart after three batches of Silver whose days overlap, each followed by an incremental run."""
    lake, e = Lake(spark, scratch(spark)), _silver(spark, sf_dir)
    for batch in ("event_id % 4 < 2", "event_id % 4 = 2 AND day(event_time) > 12", "event_id % 4 = 3 OR event_id % 4 = 2"):
        lake.table("silver").merge_insert(e.filter(batch), ["event_key"], ["event_date"])
        lake.rebuild_daily(PINNED)
    return lake.table("mart_daily_summary").read().drop("last_recomputed_at").withColumn("total_revenue", F.round("total_revenue", 2))


def _raw_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Events as CSV files in two folders of the raw zone; of every hundredth event the price is no number."""
    e = clickstream(spark, sf_dir).withColumn("category_id", F.lit(1))
    price = F.when(F.col("event_id") % 100 == 7, "n/a").otherwise(F.col("price").cast("string"))
    columns = ["event_time", "event_type", "product_id", "category_id", "category_code", "brand", price.alias("price"), "user_id", "user_session"]
    for k in (0, 1):
        e.filter(f"event_id % 2 = {k}").select(*columns).write.option("header", True).csv(f"{folder}/ingested_date=2024-02-0{k + 1}")


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that land in Bronze by day, and those set aside; the second landing finds nothing new."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    for _ in range(2):
        lake.land(f"{lake.root}/raw", PINNED, "b1")
    return _landed(lake)


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the file source of a stream, in two starts."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    for _ in range(2):
        landings.land(lake, f"{lake.root}/raw", PINNED)
    return _landed(lake)


def _landed(lake: Lake) -> DataFrame:
    count = lambda rows, day: rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return count(lake.table("bronze").read(), F.col("event_date").cast("string")).unionByName(count(lake.spark.read.parquet(f"{lake.root}/quarantine"), F.lit("set aside")))


def silver_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in Silver after two refinements by watermark, of which the second sees a month's late events only within its lookback of 40 days."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    for k in (1, 2):
        lake.land(f"{lake.root}/raw/ingested_date=2024-02-0{k}", PINNED, f"b{k}")
        lake.refine(PINNED, timedelta(days=40))
    return lake.table("silver").read().select("event_key", "event_date", "category_l1")


def stream_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and events by day in the mart that a stream of Bronze files feeds, started after each of two landings."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    for k in (1, 2):
        landings.land(lake, f"{lake.root}/raw/ingested_date=2024-02-0{k}", PINNED, f"landing{k}")
        landings.marts(lake, landings.bronze_stream(lake), PINNED)
    mart = lake.table("mart_daily_summary").read()
    return mart.groupBy("date").agg(F.sum("total_events").alias("total_events"), F.sum("total_purchases").alias("total_purchases"))


def replay_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver after a replay of four days of Bronze, which leaves the watermark alone."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    lake.land(f"{lake.root}/raw", PINNED, "b1")
    replays.replay(lake, "backfill", "2024-01-05", "2024-01-08", now=PINNED)
    state = spark.createDataFrame([(lake.watermark() is None,)], "isolated boolean")
    return lake.table("silver").read().groupBy("event_date").agg(F.count("*").alias("n")).join(F.broadcast(state))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a landing and a refinement tell of their rows."""
    lake = Lake(spark, scratch(spark))
    _raw_files(spark, sf_dir, f"{lake.root}/raw")
    lake.land(f"{lake.root}/raw", PINNED, "b1")
    lake.refine(PINNED)
    return lake.table("pipeline_metrics").read().select("layer", "input_rows", "output_rows", "quarantined_rows", "null_rate_pct", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (merge_insert_only, time_travel, table_history, zorder_read, replace_keys, state_upsert, model_tests, lineage_links, stream_merge, stream_sessions, rebuild_daily, landing, stream_landing, silver_incremental, stream_marts, replay_backfill, run_metrics, partition_overwrite)}


def oracle_sql() -> dict[str, str]:
    from .. import catalogue as c

    good = "event_id % 100 <> 7 AND product_id IS NOT NULL AND user_id IS NOT NULL AND event_time IS NOT NULL AND event_type IS NOT NULL"
    landed = f"WITH {CLICKSTREAM_SQL} SELECT CASE WHEN {good} THEN CAST(CAST(event_time AS DATE) AS VARCHAR) ELSE 'set aside' END AS day, count(*) AS n FROM clicks GROUP BY 1"
    clean = f"clean AS (SELECT event_key, any_value(event_date) AS event_date, any_value(event_type) AS event_type, any_value(category_l1) AS category_l1 FROM keyed WHERE {good} AND user_session IS NOT NULL AND price >= 0 GROUP BY event_key)"
    e = "SELECT event_id, ts, user_id, event_type, value FROM events"
    values = lambda rows: "(VALUES " + ", ".join(map(str, rows)) + ")"
    tests = [(m, i, 0) for m, n in TESTS.items() for i in range(n)]
    links = [(a, m) for m, needs in NEEDS.items() for a in needs.split()]
    return {
        "model_tests": f"SELECT model, CAST(test AS INTEGER) AS test, CAST(violations AS BIGINT) AS violations FROM {values(tests)} t(model, test, violations)",
        "lineage_links": f"SELECT source, target FROM {values(links)} t(source, target)",
        "merge_insert_only": e,
        "time_travel": f"{e} WHERE event_id % 2 = 0",
        "table_history": "SELECT CAST(0 AS INTEGER) AS version, 'APPEND' AS operation, count(*) AS inserted FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, 'MERGE', count(*) FROM events WHERE event_id % 2 <> 0 UNION ALL SELECT 2, 'OPTIMIZE', 0",
        "zorder_read": "SELECT event_id, user_id, value FROM events WHERE user_id BETWEEN 3 AND 8",
        "replace_keys": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06') OR event_id % 2 = 0 GROUP BY ALL""",
        "partition_overwrite": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06') OR (event_id % 2 = 0 AND CAST(ts AS DATE) <> DATE '2024-01-07') GROUP BY ALL""",
        "state_upsert": "SELECT event_type, max(ts) AS last_seen FROM events GROUP BY event_type",
        "rebuild_daily": c.FACTS + "," + c.DAILY + " SELECT * FROM daily",
        "landing": landed,
        "stream_landing": landed,
        "silver_incremental": f"{c.KEYED}, {clean} SELECT event_key, event_date, category_l1 FROM clean",
        "stream_marts": f"{c.KEYED}, {clean} SELECT CAST(event_date AS DATE) AS date, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'purchase') AS total_purchases FROM clean GROUP BY 1",
        "replay_backfill": f"{c.KEYED}, {clean} SELECT event_date, count(*) AS n, true AS isolated FROM clean WHERE event_date BETWEEN '2024-01-05' AND '2024-01-08' GROUP BY 1",
        "run_metrics": f"""{c.KEYED}, {clean}, bronze AS (SELECT count(*) AS n, count(*) FILTER (WHERE {good}) AS valid, count(*) FILTER (WHERE {good} AND user_session IS NOT NULL AND price >= 0) AS passed FROM keyed)
SELECT 'bronze' AS layer, n AS input_rows, valid AS output_rows, n - valid AS quarantined_rows, round(100.0 * (n - valid) / n, 4) AS null_rate_pct, 'SUCCESS' AS status FROM bronze
UNION ALL SELECT 'silver', valid, (SELECT count(*) FROM clean), 0, round(100.0 * (valid - passed) / valid, 4), 'SUCCESS' FROM bronze""",
        "stream_merge": "SELECT event_id, user_id, event_type, value FROM events",
        "stream_sessions": f"""WITH {CLICKSTREAM_SQL},
g AS (SELECT user_id, event_time, lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time) AS p FROM clicks),
s AS (SELECT user_id, event_time, sum(CASE WHEN p IS NULL OR epoch_us(event_time) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(event_time) AS started, count(*) AS n FROM s GROUP BY user_id, k""",
    }
