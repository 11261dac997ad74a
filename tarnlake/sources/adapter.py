"""Clickstream events from the driver's ``events`` and ``part`` tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_time, event_type, product_id, price, user_id, user_session, brand, category_code.

    Products come from the event's properties; every fiftieth event has no session, every seventh no category.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").alias("event_time"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        (F.round(F.col("value") / 50) * 50).alias("price"), "user_id",
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), F.col("ts").cast("date").cast("string"))).alias("user_session"),
    )
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size")
    kind = F.lower("p_type")
    code = F.when(F.col("event_id") % 7 == 0, None).when(F.col("p_size") % 3 == 0, kind).otherwise(F.concat(kind, F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))))
    return e.join(p, e["product_id"] == p["p_partkey"], "left").select(*e.columns, F.col("p_brand").alias("brand"), code.alias("category_code"))


CLICKSTREAM_SQL = """
e0 AS (
  SELECT event_id, ts AS event_time, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
    round(value / 50) * 50 AS price, user_id,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('s', CAST(user_id AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) END AS user_session
  FROM events),
clicks AS (
  SELECT e0.*, p.p_brand AS brand,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN p.p_size % 3 = 0 THEN lower(p.p_type)
      ELSE concat(lower(p.p_type), '.', lower(replace(p.p_brand, '#', ''))) END AS category_code
  FROM e0 LEFT JOIN part p ON e0.product_id = p.p_partkey)"""
