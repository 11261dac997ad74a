"""Column functions: keys, categories and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(event_time: Column) -> Column:
    """ISO-8601 to the second, with Z."""
    return F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_key() -> Column:
    """The deterministic key of an event. Null parts are skipped, as concat_ws does."""
    parts = [F.col("user_id").cast("string"), F.col("event_type"), F.col("product_id").cast("string"), iso_time(F.col("event_time"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def category_level(code: Column, level: int) -> Column:
    """Part ``level`` (from 1) of a dotted category; null where there is none."""
    return F.get(F.split(code, "[.]"), F.lit(level - 1))


def category_levels(code: str = "category_code") -> dict[str, Column]:
    return {f"category_l{i}": category_level(F.col(code), i) for i in (1, 2, 3)}


def surrogate_key(*parts: Column) -> Column:
    """MD5 of the parts joined by underscores; null if any part is null."""
    texts = [p.cast("string") for p in parts]
    joined = texts[0]
    for t in texts[1:]:
        joined = F.concat(joined, F.lit("_"), t)
    return F.md5(joined)


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def months_between(later: Column, earlier: Column) -> Column:
    """Difference of calendar months."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def micros(event_time: Column) -> Column:
    return F.unix_micros(event_time.cast("timestamp"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded; null where whole is 0."""
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)), digits)
