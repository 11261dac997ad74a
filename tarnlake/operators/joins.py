"""Joins beyond plain equality: as-of, enrichment, and measured join strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import micros
from .heat import by_heat
from .runs import reaches

#: Bytes of a side that may be broadcast.
MOST_BROADCAST = 64 << 20
#: Tasks that rows without a key are dealt to.
SPREAD = 256


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A broadcast hint, where the optimizer's bound on the side's bytes is small; else adaptive execution decides by the size it sees. No pass over the rows."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def asof_join(events: DataFrame, history: DataFrame, key: str, at: str = "event_time", start: str = "valid_from", end: str = "valid_to", carry: list[str] | None = None, salts: int = 1, slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """Left as-of join: the values that held at each event's time.

    Events and versions are sorted together by key and time and the last version is carried on, which
    stays linear for a key of any size, where an interval condition compares all pairs of the key.
    salts splits the events of hot keys over that many tasks; versions, the few, go to each. With
    ``slice_seconds`` a key's time is cut into slices that are sorted apart; each hands its last version
    on to the next ones, one row for each slice, and no version is copied. With ``hot`` (see ``heat``)
    only those keys are sliced. Results are the same.
    """
    if slice_seconds and hot is not None:
        ways = [lambda own, s=s: asof_join(own, _of(history, key, hot, s is not None), key, at, start, end, carry, salts, s) for s in (None, slice_seconds)]
        return by_heat(events, key, hot, *ways)
    names = carry or [c for c in history.columns if c not in (key, start, end)]
    v = F.struct(F.col(start).alias("_from"), F.col(end).alias("_to"), *names)
    kind = events.schema[at].dataType
    versions = history.filter(F.col(key).isNotNull()).select(F.col(key), F.col(start).cast(kind).alias(at), F.lit(0).alias("_side"), v.alias("_v"))
    own_hash = F.xxhash64(*[F.col(c) for c in events.columns])  # rows without a key have no version; they are only dealt out
    rows = events.withColumns({"_side": F.lit(1), "_salt": F.when(F.col(key).isNull(), F.pmod(own_hash, F.lit(SPREAD))).otherwise(F.pmod(own_hash, F.lit(salts)) if salts > 1 else F.lit(0).cast("long"))})
    versions = versions.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = rows.unionByName(versions, allowMissingColumns=True)
    parts = [key, "_salt"]
    if slice_seconds:
        both = both.withColumn("_slice", F.floor(micros(F.col(at)) / (slice_seconds * 1_000_000)))
        parts.append("_slice")
    own = Window.partitionBy(*parts).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(own))
    if slice_seconds:
        ends = both.groupBy(*parts).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(at))).alias("_own"))
        before = Window.partitionBy(key, "_salt").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.withColumn("_before", F.last("_own", ignorenulls=True).over(before)).filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("_salt").alias("_part"), F.col("_slice").alias("_at"), "_before")
        found = found.filter("_side = 1").join(handed, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")) & (F.col("_slice") == F.col("_at")), "left")
        found = found.withColumn("_last", F.coalesce("_last", "_before"))
    found = found.filter("_side = 1")
    held = F.when(F.col(key).isNotNull() & (F.col("_last._to").isNull() | (F.col(at) < F.col("_last._to"))), F.col("_last"))
    found = found.withColumn("_held", held)
    return found.select(*events.columns, *[F.col(f"_held.{c}").alias(c) for c in names])


def _of(history: DataFrame, key: str, hot: list, inside: bool) -> DataFrame:
    """The versions of hot keys, or those of all others."""
    if not hot:
        return history
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return history.filter(is_hot if inside else ~is_hot)


def interval_join(events: DataFrame, history: DataFrame, key: str, at: str = "event_time", slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """Left join of events with all versions whose interval their time lies in, also where versions overlap.

    The interval is a condition beside an equality on the key and a place among the key's beginnings: an event
    has the place of the last version that began, a version those from its own to the last one that begins before its
    end. So an event is compared with the versions that hold, and such as end before the next one begins, not with all of
    the key. ``slice_seconds`` and ``hot`` split the search of events' places as in ``asof_join``.
    """
    known = history.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    told = reaches(known, key, "valid_from")
    starts = told.groupBy(key, "valid_from").agg(F.max("place").alias("_place")).withColumn("_open", F.lit(None).cast("timestamp"))
    asked = events.withColumn("_time", F.col(at).cast(history.schema["valid_from"].dataType))
    placed = asof_join(asked, starts, key, "_time", end="_open", carry=["_place"], slice_seconds=slice_seconds, hot=hot)
    h = told.withColumn("_held", F.explode(F.sequence("place", "reach"))).drop("place", "reach").withColumnRenamed(key, "_key")
    cond = (placed[key] == h["_key"]) & (placed["_place"] == h["_held"]) & (placed[at] >= h["valid_from"]) & (h["valid_to"].isNull() | (placed[at] < h["valid_to"]))
    return placed.join(h, cond, "left").drop("_key", "_held", "_place", "_time")


def enrich(events: DataFrame, products: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Events with their session and, where their own values are null, the product's latest attributes.

    Sessionized events bear their session already; only where sessions come from elsewhere are they
    joined by event_key, which costs a shuffle of both sides.
    """
    p = products.select("product_id", *[F.col(c).alias(f"_{c}") for c in ("brand", "category_code", "category_l1", "category_l2", "category_l3")], F.col("latest_price").alias("product_latest_price"))
    own = events if sessions is None else events.join(sessions.select("event_key", "session_id", "user_session_seq"), "event_key")
    joined = own.join(p, "product_id", "left")
    filled = {c: F.coalesce(c, f"_{c}") for c in ("brand", "category_code", "category_l1", "category_l2", "category_l3")}
    return joined.withColumns(filled).drop(*[f"_{c}" for c in filled])


def forced_merge(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right.hint("merge"), on)


def checked_broadcast(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(small(right), on)


def affected_dates(spark: SparkSession, since: str, *facts: tuple[DataFrame, str]) -> DataFrame:
    """Distinct days of rows that came in after ``since``; facts are (rows with ingested_at, time column)."""
    days = [f.filter(F.col("ingested_at") > F.lit(since).cast("timestamp_ntz")).select(F.col(t).cast("date").alias("affected_date")) for f, t in facts]
    out = days[0]
    for d in days[1:]:
        out = out.union(d)
    return out.distinct()
