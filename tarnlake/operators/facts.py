"""Facts and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_key, months_between, ratio
from .joins import asof_join, small


def fact_events(enriched: DataFrame, dates: DataFrame, customers: DataFrame, products: DataFrame, salts: int = 1, slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """One row for each event, with the keys of its day, its customer, and the product version of its time."""
    dated = enriched.withColumn("_day", F.col("event_time").cast("date")).join(small(dates.select("date_key", F.col("date_day").alias("_day"))), "_day", "left").drop("_day")
    named = dated.join(customers.select("user_id", "customer_key"), "user_id", "left")
    keyed = asof_join(named, products, "product_id", carry=["product_key"], salts=salts, slice_seconds=slice_seconds, hot=hot)
    keep = ["event_key", "session_id", "user_session_seq", "date_key", "customer_key", "product_key", "product_id", "user_id", "event_type", "price", "event_time", "raw_user_session", "ingested_at", "batch_id"]
    return keyed.withColumnRenamed("user_session", "raw_user_session").select(*[c for c in keep if c in keyed.columns or c == "raw_user_session"])


def fact_purchases(events: DataFrame) -> DataFrame:
    """The purchases among fact_events."""
    more = [c for c in ("ingested_at", "batch_id") if c in events.columns]
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_key").alias("purchase_key"), "date_key", "customer_key", "product_key", "product_id", "user_id", "session_id",
        F.col("price").alias("revenue"), F.lit(1).alias("quantity"), F.col("event_time").alias("purchased_at"), F.col("event_time").cast("date").alias("purchased_date"), *more,
    )


def daily_summary(events: DataFrame, purchases: DataFrame, products: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """date and category_l1 with events, purchases, revenue and active users; with ``affected`` (affected_date) only of those days."""
    p = products.select("product_key", "category_l1")

    def of(facts: DataFrame, at: str) -> DataFrame:
        own = facts.withColumn("date", F.col(at).cast("date"))
        if affected is not None:
            own = own.join(affected.select(F.col("affected_date").alias("date")), "date", "left_semi")
        return own.join(p, "product_key", "left").withColumn("category_l1", F.coalesce("category_l1", F.lit("unknown"))).groupBy("date", "category_l1")

    e = of(events, "event_time").agg(F.count("*").alias("total_events"), F.count_distinct("user_id").alias("active_users"))
    b = of(purchases, "purchased_at").agg(F.count("*").alias("total_purchases"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"))
    both = e.join(b, ["date", "category_l1"], "full")
    zero = {"total_events": 0, "total_purchases": 0, "total_revenue": 0.0, "active_users": 0}
    return both.select("date", "category_l1", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in zero.items()])


def daily_rollup(events: DataFrame, category: str = "category_l1") -> DataFrame:
    """The same from events that bear the category of their product's version: every purchase is an event of its day, so one aggregation gives all four measures."""
    bought = F.col("event_type") == "purchase"
    own = events.groupBy(F.col("event_time").cast("date").alias("date"), F.coalesce(category, F.lit("unknown")).alias("category_l1"))
    return own.agg(
        F.count("*").alias("total_events"), F.count_if(bought).alias("total_purchases"),
        F.coalesce(F.sum(F.when(bought, F.col("price"))), F.lit(0.0)).alias("total_revenue"), F.count_distinct("user_id").alias("active_users"),
    )


def cohort_grid(purchases: DataFrame, dates: DataFrame) -> DataFrame:
    """Each customer with every month from the first purchase to the last month of all, and the purchases in it.

    The months between two dates are few, so each customer's are generated in place; there is no cross join.
    """
    month = F.trunc(F.col("purchased_at").cast("date"), "MM")
    ends = purchases.agg(F.min(F.col("purchased_at").cast("date")).alias("first"), F.max(F.col("purchased_at").cast("date")).alias("last"))
    spine = dates.join(F.broadcast(ends), (F.col("date_day") >= F.col("first")) & (F.col("date_day") <= F.col("last"))).select(F.trunc("date_day", "MM").alias("m")).distinct()
    months = spine.agg(F.array_sort(F.collect_list("m")).alias("months"))  # at most the months of the date dimension
    first = purchases.groupBy("customer_key", "user_id").agg(F.trunc(F.min(F.col("purchased_at").cast("date")), "MM").alias("cohort_month"))
    grid = first.join(F.broadcast(months)).select("customer_key", "user_id", "cohort_month", F.explode(F.filter("months", lambda m: m >= F.col("cohort_month"))).alias("activity_month"))
    counted = purchases.groupBy("customer_key", month.alias("activity_month")).agg(F.count("*").alias("purchase_count"))
    out = grid.join(counted, ["customer_key", "activity_month"], "left")
    n = F.coalesce("purchase_count", F.lit(0))
    return out.select(
        "customer_key", "user_id", "cohort_month", "activity_month", months_between(F.col("activity_month"), F.col("cohort_month")).alias("months_since_first_purchase"),
        n.alias("purchase_count"), (n > 0).alias("made_purchase"),
    )


def retention(grid: DataFrame) -> DataFrame:
    size = grid.filter("months_since_first_purchase = 0").groupBy("cohort_month").agg(F.count_distinct("customer_key").alias("cohort_size"))
    kept = grid.groupBy("cohort_month", "months_since_first_purchase").agg(F.count_distinct(F.when(F.col("made_purchase"), F.col("customer_key"))).alias("retained_count"))
    return kept.join(size, "cohort_month").select("cohort_month", "months_since_first_purchase", "cohort_size", "retained_count", ratio(F.col("retained_count"), F.col("cohort_size")).alias("retention_rate"))


def id_bitmaps(rows: DataFrame, by: list[str], key: str = "user_id") -> DataFrame:
    """The distinct whole-number ids of each group as bitmaps of bounded size, one for each stretch of ids: ``by``, bucket, bits. Parts by finer groups merge into coarser ones (``distinct_ids``) without the rows. Null ids are left out."""
    at = F.col(key).cast("long")
    return rows.filter(at.isNotNull()).groupBy(*by, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def distinct_ids(bitmaps: DataFrame, by: list[str], name: str = "active_users") -> DataFrame:
    """How many distinct ids each group has, exactly, from bitmaps by these or finer groups."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def cohort_bitmaps(purchases: DataFrame) -> DataFrame:
    """cohort_month, activity_month, bucket, bits: which customers of a cohort bought in a month. Rows of a month can be made anew alone; there is no row for each customer and month."""
    month = F.trunc(F.col("purchased_at").cast("date"), "MM")
    bought = purchases.filter("user_id IS NOT NULL").groupBy("user_id", month.alias("activity_month")).agg(F.count("*").alias("n"))
    first = bought.groupBy("user_id").agg(F.min("activity_month").alias("cohort_month"))
    return id_bitmaps(bought.join(first, "user_id"), ["cohort_month", "activity_month"])


def retention_from(bitmaps: DataFrame) -> DataFrame:
    """The retention of ``retention(cohort_grid(...))``, from cohort bitmaps: every cohort with every month from its own to the last, months without a purchase too."""
    kept = distinct_ids(bitmaps, ["cohort_month", "activity_month"], "retained_count")
    size = kept.filter("activity_month = cohort_month").select("cohort_month", F.col("retained_count").alias("cohort_size"))
    last = kept.agg(F.max("activity_month").alias("last"))
    months = F.explode(F.sequence("cohort_month", "last", F.expr("INTERVAL 1 MONTH")))
    every = size.join(F.broadcast(last)).select("cohort_month", "cohort_size", months.alias("activity_month"))  # a row for each cohort and month
    n = F.coalesce("retained_count", F.lit(0).cast("long"))
    out = every.join(kept, ["cohort_month", "activity_month"], "left")
    return out.select("cohort_month", months_between(F.col("activity_month"), F.col("cohort_month")).alias("months_since_first_purchase"), "cohort_size", n.alias("retained_count"), ratio(n, F.col("cohort_size")).alias("retention_rate"))


def category_performance(purchases: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """Orders and revenue by category and month, against the category's month before (the one before that has rows)."""
    p = products.select(key, "category_l1")
    monthly = (
        purchases.join(p, key, "left")
        .groupBy(F.coalesce("category_l1", F.lit("unknown")).alias("category_l1"), F.trunc(F.col("purchased_at").cast("date"), "MM").alias("period"))
        .agg(F.count_distinct("purchase_key").alias("total_orders"), F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("total_revenue"))
    )
    own = Window.partitionBy("category_l1").orderBy("period")
    prior = monthly.withColumns({"prior_period_revenue": F.lag("total_revenue").over(own), "prior_period_orders": F.lag("total_orders").over(own)})
    label = F.when(F.col("prior_period_revenue").isNull(), "new_category").when(F.col("prior_period_revenue") == 0, "no_prior_revenue").otherwise("comparable")
    return prior.withColumns({"revenue_growth_rate": ratio(F.col("total_revenue") - F.col("prior_period_revenue"), F.col("prior_period_revenue")), "growth_rate_label": label})


__all__ = ["category_performance", "cohort_bitmaps", "cohort_grid", "daily_rollup", "daily_summary", "date_key", "distinct_ids", "fact_events", "fact_purchases", "id_bitmaps", "retention", "retention_from"]
