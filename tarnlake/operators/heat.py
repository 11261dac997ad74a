"""Keys that hold a large share of all rows, told by a sketch, so that only they are worked on in slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds this share of all rows, and so many rows, that one task should not sort them.
SHARE, LEAST = 1 / 64, 1_000_000
#: Items that the sketch keeps track of; its error is a few times the rows divided by this.
TRACKED = 4096


def hot_keys(rows: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> list:
    """The keys with at least ``share`` of all rows and ``least`` rows, as far as a sketch of frequent items can tell; there are at most 1 / share. One pass over the key alone, by partial aggregation.

    What the sketch misses or overrates changes how the work is dealt, never its result.
    """
    most = min(1000, int(1 / share) + 1)
    found = rows.filter(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top")).first()
    return sorted(t["item"] for t in found["top"] or [] if t["count"] >= max(least, share * found["n"]))


def by_heat(rows: DataFrame, key: str, hot: list, plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """plain for the rows of other keys and without a key, sliced for those of hot ones."""
    if not hot:
        return plain(rows)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return plain(rows.filter(~is_hot)).unionByName(sliced(rows.filter(is_hot)))
