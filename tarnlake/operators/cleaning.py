"""Filters with counts, lateness windows, keys and deduplication."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category_levels, event_key, iso_time

FIRST_TIME = datetime(2019, 1, 1)


def business_rules(now: Column) -> dict[str, Column]:
    """In order: a session, a price of at least 0 (null fails, NaN passes), and a time between 2019 and now."""
    return {
        "session": F.col("user_session").isNotNull(),
        "price": F.col("price") >= 0,
        "time": (F.col("event_time") >= F.lit(FIRST_TIME).cast("timestamp_ntz")) & (F.col("event_time") <= now),
    }


def apply_business_rules(events: DataFrame, now: Column) -> DataFrame:
    keep = F.lit(True)
    for rule in business_rules(now).values():
        keep = keep & F.coalesce(rule, F.lit(False))
    return events.filter(keep)


def drop_counts(events: DataFrame, now: Column) -> DataFrame:
    """One row with the rows before, those dropped by each rule in turn, and those left; a single pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("rows_in")]
    for name, rule in business_rules(now).items():
        ok = F.coalesce(rule, F.lit(False))
        aggs.append(F.count_if(passed & ~ok).alias(f"dropped_{name}"))
        passed = passed & ok
    return events.agg(*aggs, F.count_if(passed).alias("rows_out"))


def since_watermark(events: DataFrame, watermark: datetime | None, lookback: timedelta = timedelta(days=3), partition: str | None = None) -> DataFrame:
    """Events not older than the watermark less the lookback. With a date partition column, whole partitions are skipped too."""
    if watermark is None:
        return events
    cutoff = watermark - lookback
    out = events.filter(F.col("event_time") >= F.lit(cutoff.isoformat(sep=" ")).cast(events.schema["event_time"].dataType))
    return out if partition is None else out.filter(F.col(partition) >= F.lit(cutoff.date()))


def in_range(events: DataFrame, start: str, end: str, whole_last_day: bool = False) -> DataFrame:
    """Both ends inclusive as times: an end without a time of day is its midnight, or with ``whole_last_day`` all of that day."""
    kind = events.schema["event_time"].dataType
    low = F.col("event_time") >= F.lit(start).cast(kind)
    high = F.col("event_time") < (F.lit(end).cast("date") + F.expr("INTERVAL 1 DAY")).cast(kind) if whole_last_day else F.col("event_time") <= F.lit(end).cast(kind)
    return events.filter(low & high)


def parse_category(events: DataFrame) -> DataFrame:
    return events.withColumns(category_levels())


def with_event_key(events: DataFrame) -> DataFrame:
    """Adds event_key and makes event_date its ISO day as text."""
    return events.withColumns({"event_key": event_key(), "event_date": F.date_format("event_time", "yyyy-MM-dd")})


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_rate(rows: DataFrame, key: str) -> DataFrame:
    """rows, distinct_keys and duplicate_rate_pct; the rate is null for no rows."""
    n, d = F.count("*"), F.count_distinct(key)
    return rows.agg(n.alias("rows"), d.alias("distinct_keys"), F.round(100 * (n - d) / F.nullif(n, F.lit(0)), 4).alias("duplicate_rate_pct"))


def keep_latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``newest`` (nulls least), which should end in a tie-breaker.

    An aggregate, not a window: tasks keep one row for each key before the shuffle, so a key that holds a
    large share of all rows costs no more than others.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(*newest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select("_best.*")


def stage_events(events: DataFrame) -> DataFrame:
    """Keyed events, one for each event_key: the latest ingested, ties to the greater event_id."""
    keyed = with_event_key(parse_category(events))
    order = [c for c in ("ingested_at", "event_id") if c in keyed.columns]
    return keep_latest(keyed, ["event_key"], order or ["event_time"])


def latest_products(events: DataFrame) -> DataFrame:
    """Each product's attributes at its last event."""
    last = keep_latest(events.filter("product_id IS NOT NULL"), ["product_id"], ["event_time", "event_key"])
    keep = [c for c in ("category_id", "category_code", "category_l1", "category_l2", "category_l3", "brand") if c in events.columns]
    return last.select("product_id", *keep, F.col("price").alias("latest_price"), F.col("event_time").alias("last_seen_at"))


__all__ = ["apply_business_rules", "business_rules", "drop_counts", "duplicate_groups", "duplicate_rate", "in_range", "iso_time", "keep_latest", "latest_products", "parse_category", "since_watermark", "stage_events", "with_event_key"]
