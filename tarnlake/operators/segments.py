"""What products were over time, in pieces of one day.

A segment is a run of a product's events of one day that agree in price and category, with its first and
last event. Segments of a day follow from the events of that day alone, and everything else about a
product's history - its latest attributes, its versions, the category of each moment - from its segments.
So late events are spliced into a history by making the segments of their days anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join
from .runs import number_runs

#: Parts that products are dealt to, so that the segments of some products lie in some files.
BUCKETS = 64
#: Hot products are sliced by hours.
SLICE = 3600


def day_segments(events: DataFrame, hot: list | None = None) -> DataFrame:
    """Events (product_id, event_date, event_time, event_key, price, category_code, category_l1), whole days of a product, to their segments. Events without a product have none."""
    apart = lambda before, now: ~(before["event_date"].eqNullSafe(now["event_date"]) & before["price"].eqNullSafe(now["price"]) & before["category_code"].eqNullSafe(now["category_code"]))
    numbered = number_runs(events.filter("product_id IS NOT NULL"), "product_id", ["event_time", "event_key"], ["event_date", "price", "category_code"], apart, "_run", SLICE, hot or [])
    at = F.struct("event_time", "event_key")
    ends = numbered.groupBy("product_id", "event_date", "_run").agg(F.min(at).alias("a"), F.max(at).alias("b"), *[F.first(c).alias(c) for c in ("price", "category_code", "category_l1")])
    return ends.select(
        F.pmod(F.xxhash64("product_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "product_id", "event_date", F.col("a.event_time").alias("first_time"), F.col("a.event_key").alias("first_key"),
        F.col("b.event_time").alias("last_time"), F.col("b.event_key").alias("last_key"), "price", "category_code", "category_l1",
    )


def resolved(segments: DataFrame, hot: list | None = None) -> DataFrame:
    """All segments of some products, with ``category``: that of the version they lie in.

    A null category falls back to that of the product's last event; a version ends where price or category
    changes, and has its last known category. All as the product dimension has it.
    """
    last = segments.groupBy("product_id").agg(F.max_by(F.struct("category_code", "category_l1"), F.struct("last_time", "last_key")).alias("_now"))
    own = segments.join(last, "product_id").withColumns({"_code": F.coalesce("category_code", "_now.category_code"), "_l1": F.coalesce("category_l1", "_now.category_l1")})
    code = lambda row: F.coalesce(row["_code"], F.lit(""))
    changed = lambda before, now: F.coalesce(before["price"] != now["price"], F.lit(False)) | (code(before) != code(now))
    versions = number_runs(own, "product_id", ["first_time", "first_key"], ["price", "_code"], changed, "_version", SLICE, hot or [])
    known = F.last("_l1", ignorenulls=True).over(Window.partitionBy("product_id", "_version").orderBy("first_time", "first_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return versions.withColumn("category", known).select(*segments.columns, "category")


def categorised(events: DataFrame, segments: DataFrame, hot: list | None = None) -> DataFrame:
    """Events with the ``category`` of their product at their time, from the resolved segments of the events' days. Of what begins at one instant the last counts."""
    single = segments.groupBy("product_id", "first_time").agg(F.max_by("category", "first_key").alias("category"))
    history = single.select("product_id", F.col("first_time").alias("valid_from"), F.lit(None).cast(segments.schema["first_time"].dataType).alias("valid_to"), "category")
    return asof_join(events, history, "product_id", carry=["category"], slice_seconds=SLICE, hot=hot or [])
