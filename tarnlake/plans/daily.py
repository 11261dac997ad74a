"""The daily mart, kept equal to a full run by following what new events change.

``product_days`` holds every product's segments (see ``operators.segments``) with the category that each
has got. New Silver commits name (product, day) pairs, whose segments are made anew from those days alone.
With the stored segments of the same products they give the products' histories; where a stored
segment's category differs from the one before, its day changes too, though no event of it is new.
The days of both kinds are counted anew and replaced whole. Of Silver only files with those days are
read, and of ``product_days`` only those with the products or days.

A run stores the days that it is about to change before it changes anything, and its Silver version when
all is done. So one that died is made good by the next, whatever it had written.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, heat, segments
from ..sources.table import Table

EVENT = ["product_id", "event_date", "event_time", "event_key", "price", "category_code", "category_l1"]
NEEDED = ["product_id", "event_date", "event_time", "event_type", "price", "user_id"]
PAIR = ["bucket", "product_id", "event_date"]


@dataclass
class Daily:
    """The tables that the mart is made from and kept in."""

    silver: Table
    product_days: Table
    mart: Table
    pending: Table
    state: Table
    #: Rows from which on a key may be hot.
    least: int = heat.LEAST

    def seen(self) -> int | None:
        """The Silver version of the last whole run."""
        return self.state.read().agg(F.max("silver_version")).first()[0] if self.state.exists() else None

    def rebuild(self, now: datetime, dates: list[str] | None = None, full: bool = False) -> tuple[int, int] | None:
        """(rows, events) of the days that were counted anew; None where nothing has changed. ``dates`` are counted anew besides."""
        version, seen = self.silver.version(), self.seen()
        if version < 0:
            return None
        if full or seen is None or not self.mart.exists() or not self.product_days.exists():
            return self._whole(version, now)
        left = self.pending.read(where=F.col("silver_version") > seen) if self.pending.exists() else None
        days = {r[0] for r in left.select("event_date").distinct().collect()} if left is not None else set()  # a row for each day
        days |= set(dates or [])
        new = self.silver.added(version, seen).select("product_id", "event_date")
        touched = {r[0] for r in new.select("event_date").distinct().collect()}
        if not days and not touched:
            return None
        if touched:
            days |= self._follow(version, new.filter("product_id IS NOT NULL").distinct(), sorted(touched), now)
        found = self._count(version, sorted(days), now)
        self.state.append(self._at(version, now))
        return found

    def _at(self, version: int, now: datetime) -> DataFrame:
        return self.silver.spark.createDataFrame([(version, now)], "silver_version int, at timestamp")

    def _announce(self, version: int, days: set[str]) -> None:
        self.pending.append(self.silver.spark.createDataFrame([(version, d) for d in sorted(days)], "silver_version int, event_date string"))

    def _hot(self, rows: DataFrame) -> list:
        return heat.hot_keys(rows, "product_id", least=self.least)

    def _whole(self, version: int, now: datetime) -> tuple[int, int]:
        events = self.silver.read(version)
        hot = self._hot(events)
        self.product_days.overwrite(segments.resolved(segments.day_segments(events.select(*EVENT), hot), hot), ["bucket", "event_date"])
        found = self._count(version, None, now)
        self.state.append(self._at(version, now))
        return found

    def _follow(self, version: int, pairs: DataFrame, touched: list[str], now: datetime) -> set[str]:
        """Splice the touched days into their products' histories; the days whose rows in the mart change by that."""
        pairs = pairs.persist()
        try:
            own = self.silver.read(version, within={"event_date": touched}).select(*EVENT).join(pairs, ["product_id", "event_date"], "left_semi")
            hot = self._hot(own)
            fresh = segments.day_segments(own, hot)
            products = pairs.select("product_id").distinct()
            bucket = F.pmod(F.xxhash64("product_id"), F.lit(segments.BUCKETS)).cast("int")
            buckets = [r[0] for r in products.select(bucket.alias("b")).distinct().collect()]  # no more than BUCKETS
            stored = self.product_days.read(within={"bucket": buckets}).join(products, "product_id", "left_semi")
            kept = stored.join(pairs, ["product_id", "event_date"], "left_anti")
            whole = segments.resolved(kept.drop("category").unionByName(fresh), hot).persist()
            was = stored.select("product_id", "event_date", "first_key", F.col("category").alias("_was"), F.lit(True).alias("_known"))
            changed = whole.join(was, ["product_id", "event_date", "first_key"], "left").filter("_known IS NULL OR NOT (category <=> _was)").select(*PAIR)
            changed = changed.unionByName(pairs.select(bucket.alias("bucket"), "product_id", "event_date")).distinct().persist()
            days = {r[0] for r in changed.select("event_date").distinct().collect()} | set(touched)
            self._announce(version, days)
            self.product_days.replace_keys(whole.join(changed, PAIR, "left_semi"), PAIR, changed)
            whole.unpersist()
            changed.unpersist()
            return days
        finally:
            pairs.unpersist()

    def _count(self, version: int, days: list[str] | None, now: datetime) -> tuple[int, int]:
        """Count some days, or all, anew."""
        within = {"event_date": days} if days is not None else None
        events = self.silver.read(version, within=within).select(*NEEDED)
        known = self.product_days.read(within=within)
        dated = segments.categorised(events, known, self._hot(events))
        rows = facts.daily_rollup(dated, "category").withColumn("last_recomputed_at", F.lit(now)).persist()
        n, read = rows.agg(F.count("*"), F.coalesce(F.sum("total_events"), F.lit(0))).first()
        if days is None:
            self.mart.overwrite(rows, ["date"])
        else:
            spark = self.silver.spark
            self.mart.replace_keys(rows, ["date"], spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("date")))
        rows.unpersist()
        return n, read
