"""Numbering the runs of a key's rows in order: sessions and versions are both of this kind. Places of a key's windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros
from .heat import by_heat

Starts = Callable[[Column, Column], Column]


def number_runs(rows: DataFrame, key: str, order: list[str], carry: list[str], starts: Starts, out: str, slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """Adds ``out``, the number (from 1) of the run that a row lies in, and ``_previous``, the carried columns of the row before.

    ``starts(previous, current)`` tells from the carried columns whether a row starts a run; a key's
    first row does, and an unknown answer is a no. ``order`` begins with a time. Rows without a key have
    nulls in both columns.

    With ``slice_seconds``, windows run within slices of a key's time, so that a key with a large share
    of all rows is sorted by many tasks. Each slice hands on one row - its ends and the runs that start
    inside it - and a key's slices, few beside its rows, tell each slice what came before. With ``hot``
    (see ``heat``) only those keys are sliced; results are the same.
    """
    if slice_seconds and hot is not None:
        whole = lambda slices: lambda part: number_runs(part, key, order, carry, starts, out, slices)
        return by_heat(rows, key, hot, whole(None), whole(slice_seconds))
    rows = rows.withColumn("_row", F.struct(*carry))
    begins = lambda before, now: F.when(starts(before, now), 1).otherwise(0)
    # rows without a key are no run; they are dealt out, so that they don't meet in one task
    rows = rows.withColumn("_spread", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*order), F.lit(256))).otherwise(F.lit(0).cast("long")))
    known = F.col(key).isNotNull()
    parts = [key, "_spread"]
    if slice_seconds:
        rows = rows.withColumn("_slice", F.floor(micros(F.col(order[0])) / (slice_seconds * 1_000_000)))
        parts.append("_slice")
    own = Window.partitionBy(*parts).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("_previous", F.lag("_row").over(own))
    first = F.col("_previous").isNull()
    told = told.withColumn("_new", F.when(first, 0 if slice_seconds else 1).otherwise(begins(F.col("_previous"), F.col("_row"))))
    told = told.withColumn("_within", F.sum("_new").over(so_far))
    if not slice_seconds:
        return told.withColumns({out: F.when(known, F.col("_within")), "_previous": F.when(known, F.col("_previous"))}).drop("_row", "_new", "_within", "_spread")
    at = F.struct(*order)
    ends = told.groupBy(*parts).agg(F.min_by("_row", at).alias("_first"), F.max_by("_row", at).alias("_last"), F.sum("_new").alias("_inside"))
    slices = Window.partitionBy(key, "_spread").orderBy("_slice")
    ends = ends.withColumn("_before", F.lag("_last").over(slices))
    ends = ends.withColumn("_opens", F.when(F.col("_before").isNull(), 1).otherwise(begins(F.col("_before"), F.col("_first"))))
    ends = ends.withColumn("_base", F.sum(F.col("_opens") + F.col("_inside")).over(slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_inside"))
    ends = ends.filter(known).select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), "_before", "_base")
    met = told.join(ends, (told[key] == ends["_key"]) & (told["_slice"] == ends["_at"]), "left")
    return met.withColumns({out: F.when(known, F.col("_base") + F.col("_within")), "_previous": F.when(known, F.coalesce("_previous", "_before"))}).drop("_row", "_new", "_within", "_slice", "_before", "_base", "_spread", "_key", "_at")


def reaches(windows: DataFrame, key: str, *order: str) -> DataFrame:
    """windows (key, valid_from, valid_to and any columns) with ``place``, that of a window among the key's by ``order``, which begins with valid_from, and ``reach``, how many of these begin before its end.

    One sweep over beginnings and ends. Windows are half open, without an end they last for ever.
    """
    own = Window.partitionBy(key)
    placed = windows.withColumn("place", F.row_number().over(own.orderBy(*order)).cast("long"))
    sides = placed.withColumn("_side", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    ends = F.col("_side") == 0
    # at one instant an end comes before a beginning
    at = [ends & F.col("valid_to").isNull(), F.when(ends, F.col("valid_to")).otherwise(F.col("valid_from")), F.col("_side")]
    so_far = own.orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sides.withColumn("reach", F.sum("_side").over(so_far)).filter(ends).drop("_side")
