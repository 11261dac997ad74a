"""Named queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import cleaning, dimensions, facts, heat, joins, sessions
from .quality import checks, reconcile
from .sources.adapter import CLICKSTREAM_SQL, clickstream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The run's pinned now, so that results don't depend on the day.
NOW = "2024-01-20 00:00:00"
WATERMARK = datetime(2024, 1, 15, 12, 0, 0)


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import showcase  # table-layer and streaming queries

    return dict(_QUERIES) | showcase.queries()


def oracle_sql() -> dict[str, str]:
    from .plans import showcase

    return dict(_SQL) | showcase.oracle_sql()


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared steps, each with its SQL -------------------------------------------

KEYED = (
    "WITH "
    + CLICKSTREAM_SQL
    + """,
keyed AS (
  SELECT *, string_split(category_code, '.')[1] AS category_l1, string_split(category_code, '.')[2] AS category_l2, string_split(category_code, '.')[3] AS category_l3,
    sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(product_id AS VARCHAR), strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'))) AS event_key,
    strftime(event_time, '%Y-%m-%d') AS event_date
  FROM clicks),
staged AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY event_id DESC) = 1)"""
)
SESSIONS = (
    KEYED
    + """,
lagged AS (SELECT *, lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_key) AS previous_event_time FROM staged),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN previous_event_time IS NULL OR epoch_us(event_time) - epoch_us(previous_event_time) > 1800000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_time, event_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_session_seq
  FROM lagged),
sessions AS (SELECT *, CAST(user_id AS VARCHAR) || '_' || CAST(user_session_seq AS VARCHAR) AS session_id FROM numbered)"""
)
ENRICHED = (
    SESSIONS
    + """,
latest AS (SELECT * FROM staged WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY event_time DESC, event_key DESC) = 1),
enriched AS (
  SELECT s.event_id, s.event_key, s.user_id, s.session_id, s.user_session_seq, s.user_session AS raw_user_session, s.event_type, s.product_id, s.price, s.event_time,
    coalesce(s.category_code, l.category_code) AS category_code, coalesce(s.category_l1, l.category_l1) AS category_l1, coalesce(s.category_l2, l.category_l2) AS category_l2,
    coalesce(s.category_l3, l.category_l3) AS category_l3, coalesce(s.brand, l.brand) AS brand, l.price AS product_latest_price
  FROM sessions s LEFT JOIN latest l ON s.product_id = l.product_id)"""
)
HISTORY = (
    ENRICHED
    + """,
marked AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN price <> lag(price) OVER w THEN 1
      WHEN coalesce(category_code, '') <> coalesce(lag(category_code) OVER w, '') THEN 1 ELSE 0 END AS is_new
  FROM enriched WHERE product_id IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY event_time, event_key)),
versioned AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY product_id ORDER BY event_time, event_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS product_version FROM marked),
spans AS (
  SELECT product_id, product_version, min(event_time) AS valid_from, arg_max(brand, {'t': event_time, 'k': event_key}) AS brand,
    arg_max(category_code, {'t': event_time, 'k': event_key}) AS category_code, arg_max(category_l1, {'t': event_time, 'k': event_key}) AS category_l1,
    arg_max(category_l2, {'t': event_time, 'k': event_key}) AS category_l2, arg_max(category_l3, {'t': event_time, 'k': event_key}) AS category_l3,
    arg_max(price, {'t': event_time, 'k': event_key}) AS price
  FROM versioned GROUP BY product_id, product_version),
single AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY product_id, valid_from ORDER BY product_version DESC) = 1),
history AS (
  SELECT md5(CAST(product_id AS VARCHAR) || '_' || CAST(valid_from AS VARCHAR)) AS product_key, product_id, product_version, brand, category_code, category_l1, category_l2,
    category_l3, price, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current
  FROM single WINDOW w AS (PARTITION BY product_id ORDER BY valid_from))"""
)
DATES = """
dates AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date_day, CAST(dayofweek(d) AS INTEGER) AS day_of_week, strftime(d, '%A') AS day_name,
    CAST(month(d) AS INTEGER) AS month, strftime(d, '%B') AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, dayofweek(d) IN (0, 6) AS is_weekend
  FROM range(DATE '2019-01-01', DATE '2028-01-01', INTERVAL 1 DAY) t(d))"""
FACTS = (
    HISTORY
    + ","
    + DATES
    + """,
customers AS (
  SELECT md5(CAST(user_id AS VARCHAR)) AS customer_key, user_id, min(event_time) AS first_seen_at, CAST(strftime(CAST(min(event_time) AS DATE), '%Y%m%d') AS INTEGER) AS first_seen_date_key
  FROM enriched WHERE user_id IS NOT NULL GROUP BY user_id),
fact_events AS (
  SELECT e.event_key, e.session_id, e.user_session_seq, d.date_key, c.customer_key, h.product_key, e.product_id, e.user_id, e.event_type, e.price, e.event_time, e.raw_user_session
  FROM enriched e LEFT JOIN dates d ON CAST(e.event_time AS DATE) = d.date_day LEFT JOIN customers c ON e.user_id = c.user_id
    LEFT JOIN history h ON e.product_id = h.product_id AND e.event_time >= h.valid_from AND (h.valid_to IS NULL OR e.event_time < h.valid_to)),
fact_purchases AS (
  SELECT event_key AS purchase_key, date_key, customer_key, product_key, product_id, user_id, session_id, price AS revenue, 1 AS quantity, event_time AS purchased_at,
    CAST(event_time AS DATE) AS purchased_date
  FROM fact_events WHERE event_type = 'purchase')"""
)
DAILY = """
ev AS (
  SELECT CAST(f.event_time AS DATE) AS date, coalesce(p.category_l1, 'unknown') AS category_l1, count(*) AS total_events, count(DISTINCT f.user_id) AS active_users
  FROM fact_events f LEFT JOIN history p USING (product_key) GROUP BY 1, 2),
pu AS (
  SELECT CAST(f.purchased_at AS DATE) AS date, coalesce(p.category_l1, 'unknown') AS category_l1, count(*) AS total_purchases, coalesce(sum(f.revenue), 0.0) AS total_revenue
  FROM fact_purchases f LEFT JOIN history p USING (product_key) GROUP BY 1, 2),
daily AS (
  SELECT coalesce(e.date, p.date) AS date, coalesce(e.category_l1, p.category_l1) AS category_l1, coalesce(e.total_events, 0) AS total_events,
    coalesce(p.total_purchases, 0) AS total_purchases, round(coalesce(p.total_revenue, 0.0), 2) AS total_revenue, coalesce(e.active_users, 0) AS active_users
  FROM ev e FULL OUTER JOIN pu p ON e.date = p.date AND e.category_l1 = p.category_l1)"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stage_events(clickstream(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = staged(spark, sf_dir)
    return joins.enrich(sessions.sessionize(e), cleaning.latest_products(e))


class Star:
    """The dimensions and facts of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        e = enriched(spark, sf_dir)
        self.dates = dimensions.date_dimension(spark)
        self.customers = dimensions.customer_dimension(e)
        self.products = dimensions.product_history(e)
        self.events = facts.fact_events(e, self.dates, self.customers, self.products)
        self.purchases = facts.fact_purchases(self.events)


# -- scans, filters and projections ---------------------------------------------


@query(
    "scan_project_filter",
    "WITH " + CLICKSTREAM_SQL + " SELECT event_id, user_id AS customer, price FROM clicks WHERE event_type = 'purchase' AND price > 100 AND event_type IN ('purchase', 'view')",
)
def scan_project_filter(spark, sf_dir):
    e = clickstream(spark, sf_dir)
    return e.filter((F.col("event_type") == "purchase") & (F.col("price") > 100) & F.col("event_type").isin("purchase", "view")).select("event_id", F.col("user_id").alias("customer"), "price")


@query("business_filters", f"WITH {CLICKSTREAM_SQL} SELECT event_id, event_time, price FROM clicks WHERE user_session IS NOT NULL AND price >= 0 AND event_time >= '2019-01-01' AND event_time <= TIMESTAMP '{NOW}'")
def business_filters(spark, sf_dir):
    return cleaning.apply_business_rules(clickstream(spark, sf_dir), _now()).select("event_id", "event_time", "price")


@query(
    "filter_drop_counts",
    f"""WITH {CLICKSTREAM_SQL}, f AS (SELECT user_session IS NOT NULL AS a, coalesce(price >= 0, false) AS b, event_time >= '2019-01-01' AND event_time <= TIMESTAMP '{NOW}' AS c FROM clicks)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT a) AS dropped_session, count(*) FILTER (WHERE a AND NOT b) AS dropped_price,
  count(*) FILTER (WHERE a AND b AND NOT c) AS dropped_time, count(*) FILTER (WHERE a AND b AND c) AS rows_out FROM f""",
)
def filter_drop_counts(spark, sf_dir):
    return cleaning.drop_counts(clickstream(spark, sf_dir), _now())


@query("watermark_lookback", f"WITH {CLICKSTREAM_SQL} SELECT event_id, event_time FROM clicks WHERE event_time >= TIMESTAMP '{WATERMARK}' - INTERVAL 3 DAY")
def watermark_lookback(spark, sf_dir):
    return cleaning.since_watermark(clickstream(spark, sf_dir), WATERMARK).select("event_id", "event_time")


@query("backfill_range", f"WITH {CLICKSTREAM_SQL} SELECT event_id, event_time FROM clicks WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time <= TIMESTAMP '2024-01-08'")
def backfill_range(spark, sf_dir):
    return cleaning.in_range(clickstream(spark, sf_dir), "2024-01-05", "2024-01-08").select("event_id", "event_time")


@query("backfill_whole_days", f"WITH {CLICKSTREAM_SQL} SELECT event_id, event_time FROM clicks WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-09'")
def backfill_whole_days(spark, sf_dir):
    return cleaning.in_range(clickstream(spark, sf_dir), "2024-01-05", "2024-01-08", whole_last_day=True).select("event_id", "event_time")


@query("category_parse", KEYED + " SELECT event_id, category_code, category_l1, category_l2, category_l3 FROM keyed")
def category_parse(spark, sf_dir):
    return cleaning.parse_category(clickstream(spark, sf_dir)).select("event_id", "category_code", "category_l1", "category_l2", "category_l3")


@query("event_key", KEYED + " SELECT event_id, event_key, event_date FROM keyed")
def event_key(spark, sf_dir):
    return cleaning.with_event_key(clickstream(spark, sf_dir)).select("event_id", "event_key", "event_date")


# -- duplicates ------------------------------------------------------------------


def _doubled(spark, sf_dir) -> DataFrame:
    e = cleaning.with_event_key(clickstream(spark, sf_dir))
    return e.unionByName(e.filter("event_id % 10 = 0"))


_DOUBLED = KEYED + ", doubled AS (SELECT * FROM keyed UNION ALL SELECT * FROM keyed WHERE event_id % 10 = 0)"


@query("duplicate_groups", _DOUBLED + " SELECT event_key, count(*) AS n FROM doubled GROUP BY event_key HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return cleaning.duplicate_groups(_doubled(spark, sf_dir), "event_key")


@query("duplicate_rate", _DOUBLED + " SELECT count(*) AS rows, count(DISTINCT event_key) AS distinct_keys, round(100 * (count(*) - count(DISTINCT event_key)) / count(*), 4) AS duplicate_rate_pct FROM doubled")
def duplicate_rate(spark, sf_dir):
    return cleaning.duplicate_rate(_doubled(spark, sf_dir), "event_key")


@query("dedup_latest", _DOUBLED + " SELECT event_id, event_key, event_time, price FROM doubled QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY event_id DESC) = 1")
def dedup_latest(spark, sf_dir):
    return cleaning.keep_latest(_doubled(spark, sf_dir), ["event_key"], ["event_id"]).select("event_id", "event_key", "event_time", "price")


@query("stage_events", KEYED + " SELECT event_key, event_id, user_id, product_id, event_type, event_time, event_date, price, brand, category_code, category_l1, category_l2, category_l3, user_session FROM staged")
def stage_events(spark, sf_dir):
    return staged(spark, sf_dir).select("event_key", "event_id", "user_id", "product_id", "event_type", "event_time", "event_date", "price", "brand", "category_code", "category_l1", "category_l2", "category_l3", "user_session")


@query("latest_attributes", ENRICHED + " SELECT product_id, category_code, category_l1, category_l2, category_l3, brand, price AS latest_price, event_time AS last_seen_at FROM latest")
def latest_attributes(spark, sf_dir):
    return cleaning.latest_products(staged(spark, sf_dir))


# -- sessions ---------------------------------------------------------------------


@query("sessionize", SESSIONS + " SELECT event_key, user_id, session_id, user_session_seq, event_time, previous_event_time FROM sessions")
def sessionize(spark, sf_dir):
    return sessions.sessionize(staged(spark, sf_dir)).select("event_key", "user_id", "session_id", "user_session_seq", "event_time", "previous_event_time")


@query("sessionize_sliced", SESSIONS + " SELECT event_key, user_id, session_id, user_session_seq, event_time, previous_event_time FROM sessions")
def sessionize_sliced(spark, sf_dir):
    return sessions.sessionize(staged(spark, sf_dir), slice_seconds=21_600).select("event_key", "user_id", "session_id", "user_session_seq", "event_time", "previous_event_time")


@query(
    "session_summary",
    SESSIONS
    + """, one AS (SELECT user_id, session_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6 AS s FROM sessions GROUP BY ALL)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, CAST(sum(p) AS BIGINT) AS purchases, round(max(s), 3) AS longest_seconds FROM one GROUP BY user_id""",
)
def session_summary(spark, sf_dir):
    return sessions.session_summary(sessions.sessionize(staged(spark, sf_dir)))


@query(
    "session_gap_violations",
    SESSIONS
    + """, coarse AS (SELECT event_key, event_time, CAST(user_id AS VARCHAR) AS session_id FROM sessions),
gaps AS (SELECT session_id, event_key, (epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY session_id ORDER BY event_time, event_key))) / 1e6 AS gap_seconds FROM coarse)
SELECT * FROM gaps WHERE gap_seconds > 1800""",
)
def session_gap_violations(spark, sf_dir):
    """On sessions that are users, so that there are violations to find."""
    return sessions.gap_violations(sessions.sessionize(staged(spark, sf_dir)).withColumn("session_id", F.col("user_id").cast("string")))


@query("session_gaps_none", SESSIONS + " SELECT session_id, event_key, CAST(0 AS DOUBLE) AS gap_seconds FROM sessions WHERE false")
def session_gaps_none(spark, sf_dir):
    return sessions.gap_violations(sessions.sessionize(staged(spark, sf_dir)))


# -- enrichment, dimensions, facts ------------------------------------------------

_ENRICHED_COLUMNS = ["event_key", "user_id", "session_id", "user_session_seq", "event_type", "product_id", "category_code", "category_l1", "category_l2", "category_l3", "brand", "price", "product_latest_price", "event_time"]


@query("enrich_fallback", ENRICHED + f" SELECT {', '.join(_ENRICHED_COLUMNS)} FROM enriched")
def enrich_fallback(spark, sf_dir):
    return enriched(spark, sf_dir).select(*_ENRICHED_COLUMNS)


@query("enrich_by_join", ENRICHED + f" SELECT {', '.join(_ENRICHED_COLUMNS)} FROM enriched")
def enrich_by_join(spark, sf_dir):
    """The same with sessions from a table of their own, joined by event key."""
    e = staged(spark, sf_dir)
    return joins.enrich(e, cleaning.latest_products(e), sessions.sessionize(e)).select(*_ENRICHED_COLUMNS)


@query("dim_date", "WITH " + DATES + " SELECT * FROM dates")
def dim_date(spark, sf_dir):
    return dimensions.date_dimension(spark)


@query("dim_customer", FACTS + " SELECT * FROM customers")
def dim_customer(spark, sf_dir):
    return dimensions.customer_dimension(enriched(spark, sf_dir))


@query("dim_product_scd2", HISTORY + " SELECT * FROM history")
def dim_product_scd2(spark, sf_dir):
    return dimensions.product_history(enriched(spark, sf_dir))


@query("dim_product_scd2_sliced", HISTORY + " SELECT * FROM history")
def dim_product_scd2_sliced(spark, sf_dir):
    """The history with each product's events dealt to tasks by days."""
    return dimensions.product_history(enriched(spark, sf_dir), slice_seconds=86_400)


@query("scd2_overlap_none", HISTORY + " SELECT product_id, product_version, valid_from, valid_to AS covered_until FROM history WHERE false")
def scd2_overlap_none(spark, sf_dir):
    return dimensions.overlapping_versions(dimensions.product_history(enriched(spark, sf_dir)))


@query(
    "scd2_overlap",
    HISTORY
    + """, broken AS (SELECT * REPLACE (valid_to + INTERVAL 2 DAY AS valid_to) FROM history WHERE product_version % 5 = 0 UNION ALL SELECT * FROM history WHERE product_version % 5 <> 0),
reach AS (SELECT product_id, product_version, valid_from, max(coalesce(valid_to, TIMESTAMP '9999-12-31 23:59:59')) OVER (PARTITION BY product_id ORDER BY valid_from, product_version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM broken)
SELECT * FROM reach WHERE valid_from < covered_until""",
)
def scd2_overlap(spark, sf_dir):
    h = dimensions.product_history(enriched(spark, sf_dir))
    longer = F.when(F.col("product_version") % 5 == 0, F.col("valid_to") + F.expr("INTERVAL 2 DAY")).otherwise(F.col("valid_to"))
    return dimensions.overlapping_versions(h.withColumn("valid_to", longer))


@query(
    "scd2_overlapping_pairs",
    HISTORY
    + """, broken AS (SELECT * REPLACE (valid_to + INTERVAL 2 DAY AS valid_to) FROM history WHERE product_version % 5 = 0 UNION ALL SELECT * FROM history WHERE product_version % 5 <> 0)
SELECT a.product_id, a.product_version AS earlier, b.product_version AS later, a.valid_from AS earlier_from, b.valid_from AS later_from
FROM broken a JOIN broken b ON a.product_id = b.product_id AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.product_version < b.product_version))
  AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)""",
)
def scd2_overlapping_pairs(spark, sf_dir):
    """The pairs behind scd2_overlap, each once."""
    h = dimensions.product_history(enriched(spark, sf_dir))
    longer = F.when(F.col("product_version") % 5 == 0, F.col("valid_to") + F.expr("INTERVAL 2 DAY")).otherwise(F.col("valid_to"))
    return dimensions.overlapping_pairs(h.withColumn("valid_to", longer))


@query("fact_events_asof", FACTS + " SELECT * FROM fact_events")
def fact_events_asof(spark, sf_dir):
    return Star(spark, sf_dir).events


@query("fact_events_asof_salted", FACTS + " SELECT event_key, product_key FROM fact_events")
def fact_events_asof_salted(spark, sf_dir):
    """The as-of join with events of each product dealt to four tasks."""
    s = Star(spark, sf_dir)
    return joins.asof_join(s.events.drop("product_key"), s.products, "product_id", carry=["product_key"], salts=4).select("event_key", "product_key")


@query("fact_events_asof_sliced", FACTS + " SELECT event_key, product_key FROM fact_events")
def fact_events_asof_sliced(spark, sf_dir):
    """The as-of join with each product's time cut into hours, every slice handing its last version on."""
    s = Star(spark, sf_dir)
    return joins.asof_join(s.events.drop("product_key"), s.products, "product_id", carry=["product_key"], slice_seconds=3600).select("event_key", "product_key")


@query("fact_events_asof_hot", FACTS + " SELECT event_key, product_key FROM fact_events")
def fact_events_asof_hot(spark, sf_dir):
    """The as-of join with the products sliced that a sketch finds to have a hundredth of all events."""
    s = Star(spark, sf_dir)
    events = s.events.drop("product_key")
    hot = heat.hot_keys(events, "product_id", share=0.01, least=1)
    return joins.asof_join(events, s.products, "product_id", carry=["product_key"], slice_seconds=3600, hot=hot).select("event_key", "product_key")


@query("asof_by_interval", FACTS + " SELECT event_key, product_key FROM fact_events")
def asof_by_interval(spark, sf_dir):
    s = Star(spark, sf_dir)
    return joins.interval_join(s.events.drop("product_key"), s.products.select("product_id", "product_key", "valid_from", "valid_to"), "product_id").select("event_key", "product_key")


@query("fact_purchases", FACTS + " SELECT * FROM fact_purchases")
def fact_purchases(spark, sf_dir):
    return Star(spark, sf_dir).purchases


# -- marts ------------------------------------------------------------------------


@query("mart_daily_summary", FACTS + "," + DAILY + " SELECT * FROM daily")
def mart_daily_summary(spark, sf_dir):
    e = staged(spark, sf_dir)
    e = joins.enrich(e, cleaning.latest_products(e))  # sessions play no part in it
    dated = joins.asof_join(e.select("product_id", "event_time", "event_type", "price", "user_id"), dimensions.product_history(e).withColumn("category", F.col("category_l1")), "product_id", carry=["category"])
    return facts.daily_rollup(dated, "category").withColumn("total_revenue", F.round("total_revenue", 2))


#: Rows count as ingested six hours after they happened.
_INGESTED = "event_time + INTERVAL 6 HOUR"
_SINCE = "2024-01-25 00:00:00"


@query("affected_dates", FACTS + f" SELECT DISTINCT CAST(event_time AS DATE) AS affected_date FROM fact_events WHERE {_INGESTED} > TIMESTAMP '{_SINCE}'")
def affected_dates(spark, sf_dir):
    s = Star(spark, sf_dir)
    e = s.events.withColumn("ingested_at", F.expr(_INGESTED))
    p = s.purchases.withColumn("ingested_at", F.expr("purchased_at + INTERVAL 6 HOUR"))
    return joins.affected_dates(spark, _SINCE, (e, "event_time"), (p, "purchased_at"))


@query("daily_incremental", FACTS + "," + DAILY + f" SELECT * FROM daily WHERE date IN (SELECT CAST(event_time AS DATE) FROM fact_events WHERE {_INGESTED} > TIMESTAMP '{_SINCE}')")
def daily_incremental(spark, sf_dir):
    s = Star(spark, sf_dir)
    days = joins.affected_dates(spark, _SINCE, (s.events.withColumn("ingested_at", F.expr(_INGESTED)), "event_time"))
    return facts.daily_summary(s.events, s.purchases, s.products, days).withColumn("total_revenue", F.round("total_revenue", 2))


def _orders_as_purchases(spark, sf_dir) -> DataFrame:
    """Orders stand in for purchases: they span years, where events span a month."""
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("purchase_key"), fn.surrogate_key(F.col("o_custkey")).alias("customer_key"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("purchased_at"), F.col("o_totalprice").alias("revenue"))


_GRID = (
    "WITH "
    + DATES
    + """, bought AS (SELECT md5(CAST(o_custkey AS VARCHAR)) AS customer_key, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders),
cohort AS (SELECT customer_key, user_id, CAST(date_trunc('month', min(day)) AS DATE) AS cohort_month FROM bought GROUP BY ALL),
spine AS (SELECT DISTINCT CAST(date_trunc('month', date_day) AS DATE) AS activity_month FROM dates_all WHERE date_day BETWEEN (SELECT min(day) FROM bought) AND (SELECT max(day) FROM bought)),
monthly AS (SELECT customer_key, CAST(date_trunc('month', day) AS DATE) AS activity_month, count(*) AS purchase_count FROM bought GROUP BY ALL),
grid AS (
  SELECT c.customer_key, c.user_id, c.cohort_month, s.activity_month,
    CAST((year(s.activity_month) - year(c.cohort_month)) * 12 + month(s.activity_month) - month(c.cohort_month) AS INTEGER) AS months_since_first_purchase,
    coalesce(m.purchase_count, 0) AS purchase_count, coalesce(m.purchase_count, 0) > 0 AS made_purchase
  FROM cohort c JOIN spine s ON s.activity_month >= c.cohort_month LEFT JOIN monthly m ON m.customer_key = c.customer_key AND m.activity_month = s.activity_month),
kept AS (
  SELECT r.cohort_month, r.months_since_first_purchase, z.cohort_size, r.retained_count, round(CAST(r.retained_count AS DOUBLE) / nullif(z.cohort_size, 0), 4) AS retention_rate
  FROM (SELECT cohort_month, months_since_first_purchase, count(DISTINCT CASE WHEN made_purchase THEN customer_key END) AS retained_count FROM grid GROUP BY ALL) r
    JOIN (SELECT cohort_month, count(DISTINCT customer_key) AS cohort_size FROM grid WHERE months_since_first_purchase = 0 GROUP BY ALL) z USING (cohort_month))"""
).replace("dates AS (", "dates_all AS (").replace("DATE '2019-01-01'", "DATE '1990-01-01'")


def _grid(spark, sf_dir) -> DataFrame:
    return facts.cohort_grid(_orders_as_purchases(spark, sf_dir), dimensions.date_dimension(spark, "1990-01-01"))


@query("cohort_grid", _GRID + " SELECT * FROM grid")
def cohort_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query("customer_retention", _GRID + " SELECT * FROM kept")
def customer_retention(spark, sf_dir):
    return facts.retention(_grid(spark, sf_dir))


@query("customer_retention_bitmaps", _GRID + " SELECT * FROM kept")
def customer_retention_bitmaps(spark, sf_dir):
    """Retention from bitmaps by cohort and month, without a row for each customer and month."""
    return facts.retention_from(facts.cohort_bitmaps(_orders_as_purchases(spark, sf_dir)))


@query("active_users_merged", "SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT user_id) AS active_users FROM events GROUP BY ALL")
def active_users_merged(spark, sf_dir):
    """Exact distinct users of a month, merged from bitmaps by day."""
    days = facts.id_bitmaps(_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day", "event_type"])
    return facts.distinct_ids(days.withColumn("month", F.trunc("day", "MM")), ["event_type", "month"])


@query("retention_month0", _GRID + " SELECT cohort_month, retention_rate FROM kept WHERE months_since_first_purchase = 0 AND retention_rate <> 1.0")
def retention_month0(spark, sf_dir):
    return facts.retention(_grid(spark, sf_dir)).filter("months_since_first_purchase = 0 AND retention_rate <> 1.0").select("cohort_month", "retention_rate")


@query("retention_bound", _GRID + " SELECT cohort_month, months_since_first_purchase FROM kept WHERE retained_count > cohort_size")
def retention_bound(spark, sf_dir):
    return facts.retention(_grid(spark, sf_dir)).filter("retained_count > cohort_size").select("cohort_month", "months_since_first_purchase")


@query(
    "category_performance",
    """WITH monthly AS (
  SELECT coalesce(p.p_type, 'unknown') AS category_l1, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS period,
    count(DISTINCT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)) AS total_orders, round(coalesce(sum(l_extendedprice), 0.0), 2) AS total_revenue
  FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey GROUP BY 1, 2),
prior AS (SELECT *, lag(total_revenue) OVER w AS prior_period_revenue, lag(total_orders) OVER w AS prior_period_orders FROM monthly WINDOW w AS (PARTITION BY category_l1 ORDER BY period))
SELECT *, round((total_revenue - prior_period_revenue) / nullif(prior_period_revenue, 0), 4) AS revenue_growth_rate,
  CASE WHEN prior_period_revenue IS NULL THEN 'new_category' WHEN prior_period_revenue = 0 THEN 'no_prior_revenue' ELSE 'comparable' END AS growth_rate_label FROM prior""",
)
def category_performance(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("purchase_key"),
        F.col("l_partkey").alias("product_key"), F.col("l_shipdate").alias("purchased_at"), F.col("l_extendedprice").alias("revenue"),
    )
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_type").alias("category_l1"))
    return facts.category_performance(lines, parts)


# -- the benchmark suites ---------------------------------------------------------


@query("filter_brand_revenue", "WITH " + CLICKSTREAM_SQL + " SELECT brand, round(sum(price), 2) AS revenue FROM clicks WHERE event_type = 'purchase' GROUP BY brand")
def filter_brand_revenue(spark, sf_dir):
    return clickstream(spark, sf_dir).filter("event_type = 'purchase'").groupBy("brand").agg(F.round(F.sum("price"), 2).alias("revenue"))


@query("filter_brand_revenue_users", "WITH " + CLICKSTREAM_SQL + " SELECT brand, round(sum(price), 2) AS revenue FROM clicks WHERE event_type = 'purchase' AND user_id > 7 GROUP BY brand")
def filter_brand_revenue_users(spark, sf_dir):
    return clickstream(spark, sf_dir).filter("event_type = 'purchase' AND user_id > 7").groupBy("brand").agg(F.round(F.sum("price"), 2).alias("revenue"))


_BRANDS = "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


def _brand_counts(spark, sf_dir, how) -> DataFrame:
    lines, parts = _table(spark, sf_dir, "lineitem").select("l_partkey"), _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return how(lines, parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("join_sort_merge", _BRANDS)
def join_sort_merge(spark, sf_dir):
    return _brand_counts(spark, sf_dir, joins.forced_merge)


@query("join_broadcast", _BRANDS)
def join_broadcast(spark, sf_dir):
    return _brand_counts(spark, sf_dir, joins.checked_broadcast)


@query("agg_user_counts", "SELECT user_id, count(event_type) AS n FROM events GROUP BY user_id")
def agg_user_counts(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("event_type").alias("n"))


@query("trailing_average", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(count(*)) OVER (ORDER BY CAST(ts AS DATE) ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean_before FROM events GROUP BY 1")
def trailing_average(spark, sf_dir):
    return checks.trailing_volume(_table(spark, sf_dir, "events"), "ts").select("day", "n", "mean_before")


@query(
    "volume_deviation",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE NOT (day(ts) = 9 AND user_id % 2 = 0) GROUP BY 1),
t AS (SELECT *, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean_before FROM d)
SELECT day, n, mean_before FROM t WHERE abs(n - mean_before) > 0.3 * mean_before""",
)
def volume_deviation(spark, sf_dir):
    e = _table(spark, sf_dir, "events").filter("NOT (day(ts) = 9 AND user_id % 2 = 0)")
    return checks.trailing_volume(e, "ts").filter(F.abs(F.col("n") - F.col("mean_before")) > 0.3 * F.col("mean_before")).select("day", "n", "mean_before")


# -- checks ------------------------------------------------------------------------


@query(
    "check_missing",
    "WITH " + CLICKSTREAM_SQL + """ SELECT 'missing_count' AS metric, c AS columns, CAST(v AS DOUBLE) AS value, o AS outcome FROM (
  SELECT 'event_time' AS c, count(*) FILTER (WHERE event_time IS NULL) AS v, CASE WHEN count(*) FILTER (WHERE event_time IS NULL) = 0 THEN 'pass' ELSE 'fail' END AS o FROM clicks
  UNION ALL SELECT 'user_session', count(*) FILTER (WHERE user_session IS NULL), CASE WHEN count(*) FILTER (WHERE user_session IS NULL) = 0 THEN 'pass' ELSE 'fail' END FROM clicks
  UNION ALL SELECT 'category_code', count(*) FILTER (WHERE category_code IS NULL), 'pass' FROM clicks)""",
)
def check_missing(spark, sf_dir):
    c = [checks.Check("missing_count", ["event_time"], fail="> 0"), checks.Check("missing_count", ["user_session"], fail="> 0"), checks.Check("missing_count", ["category_code"])]
    return checks.run(clickstream(spark, sf_dir), c)


@query(
    "check_metrics",
    _DOUBLED
    + f""", m AS (SELECT count(*) AS n, count(DISTINCT event_key) AS d, min(price) AS p, count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase', 'click')) AS w, epoch(TIMESTAMP '{NOW}' - max(event_time)) / 86400 AS f FROM doubled)
SELECT 'row_count' AS metric, '' AS columns, CAST(n AS DOUBLE) AS value, CASE WHEN n <= 100 THEN 'fail' ELSE 'pass' END AS outcome FROM m
UNION ALL SELECT 'duplicate_count', 'event_key', CAST((SELECT count(*) FROM (SELECT 1 FROM doubled GROUP BY event_key HAVING count(*) > 1)) AS DOUBLE), 'fail' FROM m
UNION ALL SELECT 'duplicate_percent', 'event_key', round(100.0 * (n - d) / n, 4), CASE WHEN 100.0 * (n - d) / n > 50 THEN 'fail' WHEN 100.0 * (n - d) / n > 5 THEN 'warn' ELSE 'pass' END FROM m
UNION ALL SELECT 'min', 'price', p, CASE WHEN p < 0 THEN 'fail' ELSE 'pass' END FROM m
UNION ALL SELECT 'invalid_count', 'event_type', CAST(w AS DOUBLE), CASE WHEN w > 0 THEN 'fail' ELSE 'pass' END FROM m
UNION ALL SELECT 'freshness_days', 'event_time', round(f, 4), CASE WHEN f > 30 THEN 'fail' ELSE 'pass' END FROM m""",
)
def check_metrics(spark, sf_dir):
    c = [
        checks.Check("row_count", fail="<= 100"),
        checks.Check("duplicate_count", ["event_key"], fail="> 0"),
        checks.Check("duplicate_percent", ["event_key"], fail="> 50", warn="> 5"),
        checks.Check("min", ["price"], fail="< 0"),
        checks.Check("invalid_count", ["event_type"], fail="> 0", valid=["view", "purchase", "click"]),
        checks.Check("freshness_days", ["event_time"], fail="> 30"),
    ]
    return checks.run(_doubled(spark, sf_dir), c, now=NOW)


@query("check_schema", "SELECT 'event_id' AS column_name, true AS present UNION ALL SELECT 'brand', true UNION ALL SELECT 'currency', false")
def check_schema(spark, sf_dir):
    return checks.required_columns(clickstream(spark, sf_dir), ["event_id", "brand", "currency"])


@query("check_user_sql", "WITH " + CLICKSTREAM_SQL + " SELECT count(*) AS value, count(*) = 0 AS passed FROM clicks WHERE price < 0")
def check_user_sql(spark, sf_dir):
    return checks.user_sql(clickstream(spark, sf_dir), "SELECT count(*) FROM {rows} WHERE price < 0", 0)


@query("null_profile", "WITH " + CLICKSTREAM_SQL + """ SELECT 'brand' AS column_name, count(*) FILTER (WHERE brand IS NULL) AS nulls, round(100.0 * count(*) FILTER (WHERE brand IS NULL) / count(*), 4) AS null_pct FROM clicks
UNION ALL SELECT 'user_session', count(*) FILTER (WHERE user_session IS NULL), round(100.0 * count(*) FILTER (WHERE user_session IS NULL) / count(*), 4) FROM clicks
UNION ALL SELECT 'category_code', count(*) FILTER (WHERE category_code IS NULL), round(100.0 * count(*) FILTER (WHERE category_code IS NULL) / count(*), 4) FROM clicks""")  # fmt: skip
def null_profile(spark, sf_dir):
    return checks.null_profile(clickstream(spark, sf_dir).select("brand", "user_session", "category_code"))


@query("test_not_null", "SELECT event_id FROM events WHERE event_id IS NULL")
def test_not_null(spark, sf_dir):
    return checks.not_null(_table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("test_unique", "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1")
def test_unique(spark, sf_dir):
    return checks.unique(_table(spark, sf_dir, "events"), "user_id")


@query("test_accepted_values", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'purchase') GROUP BY event_type")
def test_accepted_values(spark, sf_dir):
    return checks.accepted_values(_table(spark, sf_dir, "events"), "event_type", ["view", "purchase"])


@query("test_relationships", "SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def test_relationships(spark, sf_dir):
    return checks.relationships(_table(spark, sf_dir, "lineitem"), "l_partkey", _table(spark, sf_dir, "part").filter("p_size > 10"), "p_partkey")


@query("contract_null_counts", "WITH " + CLICKSTREAM_SQL + """ SELECT 'null_in_non_nullable_column' AS rule, 'user_session' AS column_name, count(*) FILTER (WHERE user_session IS NULL OR trim(user_session) = '') AS violations FROM clicks
UNION ALL SELECT 'missing_required_column', 'currency', 1 UNION ALL SELECT 'value_not_allowed', 'event_type', count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase')) FROM clicks
UNION ALL SELECT 'value_below_minimum', 'price', count(*) FILTER (WHERE price < 100) FROM clicks""")  # fmt: skip
def contract_null_counts(spark, sf_dir):
    from .quality import contracts

    spec = {
        "columns": {
            "event_id": {"type": "long", "required": True, "nullable": False}, "user_session": {"type": "string", "required": True, "nullable": False}, "currency": {"type": "string", "required": True},
            "event_type": {"type": "string", "allowed_values": ["view", "purchase"]}, "price": {"type": "double", "min_value": 100.0},
        }
    }
    return contracts.violations(clickstream(spark, sf_dir), spec, strict=True)


# -- reconciliation ----------------------------------------------------------------


@query(
    "reconcile_layers",
    FACTS
    + ","
    + DAILY
    + """ SELECT 'rows_staged_vs_facts' AS check_name, CAST((SELECT count(*) FROM staged) AS DOUBLE) AS source_value, CAST((SELECT count(*) FROM fact_events) AS DOUBLE) AS target_value, CAST(0 AS DOUBLE) AS drift, 'PASS' AS status
UNION ALL SELECT 'revenue_facts_vs_mart', (SELECT round(sum(revenue), 2) FROM fact_purchases), (SELECT round(sum(total_revenue), 2) FROM daily), 0.0, 'PASS'
UNION ALL SELECT 'purchases_staged_vs_facts', (SELECT count(*) FROM staged WHERE event_type = 'purchase'), (SELECT count(*) FROM fact_purchases), 0.0, 'PASS'
UNION ALL SELECT 'raw_vs_staged', (SELECT count(*) FROM clicks), (SELECT count(*) FROM staged), (SELECT count(*) FROM clicks) - (SELECT count(*) FROM staged), 'PASS'""",
)
def reconcile_layers(spark, sf_dir):
    raw, e, s = clickstream(spark, sf_dir), staged(spark, sf_dir), Star(spark, sf_dir)
    daily = facts.daily_summary(s.events, s.purchases, s.products)
    return reconcile.compare(
        spark,
        [
            reconcile.Pair("rows_staged_vs_facts", e.agg(F.count("*")), s.events.agg(F.count("*"))),
            reconcile.Pair("revenue_facts_vs_mart", s.purchases.agg(F.round(F.sum("revenue"), 2)), daily.agg(F.round(F.sum("total_revenue"), 2))),
            reconcile.Pair("purchases_staged_vs_facts", e.filter("event_type = 'purchase'").agg(F.count("*")), s.purchases.agg(F.count("*"))),
            reconcile.Pair("raw_vs_staged", raw.agg(F.count("*")), e.agg(F.count("*")), at_least=True),
        ],
    )


@query("unique_grain_daily", FACTS + "," + DAILY + " SELECT date, category_l1, count(*) AS n FROM daily GROUP BY ALL HAVING count(*) > 1")
def unique_grain_daily(spark, sf_dir):
    s = Star(spark, sf_dir)
    return reconcile.unique_grain(facts.daily_summary(s.events, s.purchases, s.products), ["date", "category_l1"])


@query("preserve_row_count", FACTS + " SELECT (SELECT count(*) FROM staged) AS before, (SELECT count(*) FROM enriched) AS after WHERE (SELECT count(*) FROM staged) <> (SELECT count(*) FROM enriched)")
def preserve_row_count(spark, sf_dir):
    return reconcile.count_changed(staged(spark, sf_dir), enriched(spark, sf_dir))


# -- the same invariants on rows that break them


@query("not_null_found", "WITH " + CLICKSTREAM_SQL + " SELECT event_id FROM clicks WHERE user_session IS NULL")
def not_null_found(spark, sf_dir):
    return checks.not_null(clickstream(spark, sf_dir), "user_session").select("event_id")


@query("unique_grain_repeated", FACTS + "," + DAILY + " SELECT date, category_l1, 2 AS n FROM daily WHERE day(date) % 2 = 0")
def unique_grain_repeated(spark, sf_dir):
    """The mart with every second day twice."""
    daily = mart_daily_summary(spark, sf_dir)
    return reconcile.unique_grain(daily.unionByName(daily.filter("day(date) % 2 = 0")), ["date", "category_l1"])


@query("row_count_changed", ENRICHED + " SELECT (SELECT count(*) FROM staged) AS before, (SELECT count(*) FROM enriched WHERE category_code IS NOT NULL AND event_id % 3 = 0) AS after")
def row_count_changed(spark, sf_dir):
    """An enrichment that loses rows."""
    return reconcile.count_changed(staged(spark, sf_dir), enriched(spark, sf_dir).filter("category_code IS NOT NULL AND event_id % 3 = 0"))


@query(
    "retention_month0_broken",
    _GRID
    + """, broken AS (SELECT *, made_purchase AND NOT (months_since_first_purchase = 0 AND user_id % 7 = 0) AS bought FROM grid),
z AS (SELECT cohort_month, count(DISTINCT customer_key) AS cohort_size, count(DISTINCT CASE WHEN bought THEN customer_key END) AS retained_count FROM broken WHERE months_since_first_purchase = 0 GROUP BY 1)
SELECT cohort_month, round(CAST(retained_count AS DOUBLE) / cohort_size, 4) AS retention_rate FROM z WHERE round(CAST(retained_count AS DOUBLE) / cohort_size, 4) <> 1.0""",
)
def retention_month0_broken(spark, sf_dir):
    """A grid in which a seventh of the customers have not bought in their own first month."""
    grid = _grid(spark, sf_dir)
    broken = grid.withColumn("made_purchase", F.col("made_purchase") & ~((F.col("months_since_first_purchase") == 0) & (F.col("user_id") % 7 == 0)))
    return facts.retention(broken).filter("months_since_first_purchase = 0 AND retention_rate <> 1.0").select("cohort_month", "retention_rate")


@query(
    "reconcile_statuses",
    """SELECT 'same' AS check_name, CAST(count(*) AS DOUBLE) AS source_value, CAST(count(*) AS DOUBLE) AS target_value, CAST(0 AS DOUBLE) AS drift, 'PASS' AS status FROM events
UNION ALL SELECT 'fewer', count(*), count(*) FILTER (WHERE event_type <> 'view'), count(*) FILTER (WHERE event_type = 'view'), 'FAIL' FROM events
UNION ALL SELECT 'fewer_allowed', count(*), count(*) FILTER (WHERE event_type <> 'view'), count(*) FILTER (WHERE event_type = 'view'), 'PASS' FROM events
UNION ALL SELECT 'more', count(*) FILTER (WHERE event_type <> 'view'), count(*), -count(*) FILTER (WHERE event_type = 'view'), 'FAIL' FROM events
UNION ALL SELECT 'unknown', -1, -1, 0, 'SKIP'""",
)
def reconcile_statuses(spark, sf_dir):
    """Every status that a reconciliation can have; the last target is a table that is not there."""
    e = _table(spark, sf_dir, "events")
    n, few = e.agg(F.count("*")), e.filter("event_type <> 'view'").agg(F.count("*"))

    class Gone:
        def first(self):
            return _table(spark, sf_dir, "no_such_table").agg(F.count("*")).first()

    pair = reconcile.Pair
    return reconcile.compare(spark, [pair("same", n, n), pair("fewer", n, few), pair("fewer_allowed", n, few, at_least=True), pair("more", few, n, at_least=True), pair("unknown", n, Gone())])


@query(
    "gate_report",
    "WITH " + CLICKSTREAM_SQL + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE user_session IS NULL) AS lost, count(*) FILTER (WHERE brand IS NULL) AS plain FROM clicks)
SELECT 'rows' AS suite, CASE WHEN n < 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM t UNION ALL SELECT 'sessions', CASE WHEN lost > 0 THEN 'FAIL' ELSE 'PASS' END FROM t
UNION ALL SELECT 'brands', CASE WHEN plain > n THEN 'FAIL' ELSE 'PASS' END FROM t""",
)
def gate_report(spark, sf_dir):
    """A gate of three suites, of which one fails."""
    e, c = clickstream(spark, sf_dir), checks.Check
    suites = {"rows": [c("row_count", fail="< 1")], "sessions": [c("missing_count", ["user_session"], fail="> 0")], "brands": [c("missing_count", ["brand"], fail="> 1000000000")]}
    told = checks.gate({name: (lambda x=x: checks.run(e, x)) for name, x in suites.items()})[1]["suites"]
    return spark.createDataFrame([(name, x["status"]) for name, x in told.items()], "suite string, status string")


# -- set operations, limits ----------------------------------------------------------


@query("union_distinct", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def union_distinct(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.filter("event_type = 'purchase'").select("user_id").union(e.filter("event_type = 'signup'").select("user_id")).distinct()


@query("limit_zero", "SELECT event_id, user_id FROM events LIMIT 0")
def limit_zero(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id").limit(0)


@query("top_one", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def top_one(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


@query("global_max", "SELECT max(ts) AS newest, min(ts) AS oldest FROM events")
def global_max(spark, sf_dir):
    return _table(spark, sf_dir, "events").agg(F.max("ts").alias("newest"), F.min("ts").alias("oldest"))


@query("anti_join_new_keys", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def anti_join_new_keys(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id")
    return e.join(e.filter("event_id % 3 = 0"), "event_id", "left_anti")


@query("arg_max_skips_null", "WITH " + CLICKSTREAM_SQL + " SELECT product_id, arg_max(category_code, event_id) AS category_code FROM clicks GROUP BY product_id")
def arg_max_skips_null(spark, sf_dir):
    return clickstream(spark, sf_dir).groupBy("product_id").agg(F.expr("max_by(category_code, event_id) FILTER (WHERE category_code IS NOT NULL)").alias("category_code"))


@query("tumbling_day", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_day(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")
