"""Dimensions: dates, customers, and the history of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import date_key, surrogate_key
from .runs import number_runs, reaches

#: Versions of a product that one row holds where pairs are made.
PLACES = 1024


def date_dimension(spark: SparkSession, first: str = "2019-01-01", beyond: str = "2028-01-01") -> DataFrame:
    """A row for each day from first up to, but without, beyond."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', date_sub(DATE '{beyond}', 1), INTERVAL 1 DAY)) AS date_day")
    d = F.col("date_day")
    return days.select(
        date_key(d).alias("date_key"), "date_day", (F.dayofweek(d) - 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        (F.dayofweek(d) - 1).isin(0, 6).alias("is_weekend"),
    )


def customer_dimension(events: DataFrame) -> DataFrame:
    first = events.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.min("event_time").alias("first_seen_at"))
    return first.select(surrogate_key(F.col("user_id")).alias("customer_key"), "user_id", "first_seen_at", date_key(F.col("first_seen_at").cast("date")).alias("first_seen_date_key"))


def product_history(events: DataFrame, slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """Versions of each product: a new one where the price or category changes (a null category is an empty one; a null price on either side is no change).

    Attributes are the last non-null ones of a version, valid_to is the next version's start. Events
    at one instant are ordered by key; versions that would begin at the same instant become one.
    ``slice_seconds`` splits the work of products with very many events by time, with ``hot`` that of these
    products alone; the result is the same.
    """
    code = lambda row: F.coalesce(row["category_code"], F.lit(""))
    changed = lambda before, now: F.coalesce(before["price"] != now["price"], F.lit(False)) | (code(before) != code(now))
    numbered = number_runs(events.filter("product_id IS NOT NULL"), "product_id", ["event_time", "event_key"], ["price", "category_code"], changed, "product_version", slice_seconds, hot)
    last = lambda c: F.expr(f"max_by({c}, struct(event_time, event_key)) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    attributes = [c for c in ("brand", "category_code", "category_l1", "category_l2", "category_l3", "price") if c in events.columns]
    versions = numbered.groupBy("product_id", "product_version").agg(F.min("event_time").alias("valid_from"), *[last(c) for c in attributes])
    single = Window.partitionBy("product_id", "valid_from").orderBy(F.desc("product_version"))
    versions = versions.withColumn("_n", F.row_number().over(single)).filter("_n = 1").drop("_n")
    after = F.lead("valid_from").over(Window.partitionBy("product_id").orderBy("valid_from"))
    out = versions.withColumn("valid_to", after)
    return out.select(surrogate_key(F.col("product_id"), F.col("valid_from")).alias("product_key"), "product_id", "product_version", *attributes, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def overlapping_pairs(history: DataFrame) -> DataFrame:
    """Each pair of versions of one product whose windows overlap, once: the one that begins first (of equals the lesser version) as ``earlier``, the other as ``later``.

    Versions are placed in the order of their beginnings. One sweep over beginnings and ends tells each
    version how many begin before it ends; those after its own place are what it overlaps. They are read from
    rows of PLACES versions each, with which a version is joined once, however many of these it overlaps: no
    row is made that is no pair, and no pair is shuffled. Windows are half open, without an end they last for
    ever; a window that ends no later than it begins overlaps nothing. Null products have no versions.
    """
    known = history.filter("product_id IS NOT NULL").select("product_id", "product_version", "valid_from", "valid_to").filter("valid_to IS NULL OR valid_to > valid_from")
    told = reaches(known, "product_id", "valid_from", "product_version")
    versions = F.sort_array(F.collect_list(F.struct("place", F.col("product_version").alias("later"), F.col("valid_from").alias("later_from")))).alias("versions")
    blocks = told.groupBy("product_id", F.expr(f"(place - 1) div {PLACES}").alias("block")).agg(versions)
    met = told.filter("reach > place").select("product_id", F.col("product_version").alias("earlier"), F.col("valid_from").alias("earlier_from"), "place", "reach", F.explode(F.expr(f"sequence(place div {PLACES}, (reach - 1) div {PLACES})")).alias("block"))
    first = F.greatest(F.col("place") - F.col("block") * PLACES, F.lit(0))
    beyond = F.least(F.col("reach") - F.col("block") * PLACES, F.lit(PLACES))
    later = F.slice("versions", (first + 1).cast("int"), (beyond - first).cast("int"))
    pairs = met.join(blocks, ["product_id", "block"]).select("product_id", "earlier", "earlier_from", F.explode(later).alias("v"))
    return pairs.select("product_id", "earlier", "v.later", "earlier_from", "v.later_from")


def overlapping_versions(history: DataFrame) -> DataFrame:
    """Pairs of versions of one product whose windows overlap. Ordered by start, an overlap shows between neighbours with the greatest end so far, so no self-join of a hot product is needed to tell whether there are any."""
    far = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    own = Window.partitionBy("product_id").orderBy("valid_from", "product_version")
    end = F.coalesce("valid_to", far)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("_reach", reach).filter(F.col("valid_from") < F.col("_reach")).select("product_id", "product_version", "valid_from", F.col("_reach").alias("covered_until"))
