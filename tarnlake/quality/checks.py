"""Checks as metrics with thresholds: all metrics of a run come from one pass over the rows."""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt, "!=": operator.ne, "=": operator.eq}


@dataclass(frozen=True)
class Check:
    """A metric over columns. fail and warn are conditions such as ``> 0``; without any the metric is for information."""

    metric: str
    columns: list[str] = field(default_factory=list)
    fail: str | None = None
    warn: str | None = None
    valid: list | None = None


def _meets(condition: str | None, value: float | None) -> bool:
    if condition is None:
        return False
    sign, bound = re.fullmatch(r"\s*(<=|>=|!=|<|>|=)\s*(-?[\d.]+)\s*", condition).groups()
    return value is None or _COMPARE[sign](value, float(bound))


def _metric(check: Check, now: str | None) -> Column | None:
    c = [F.col(x) for x in check.columns]
    match check.metric:
        case "row_count":
            out = F.count("*")
        case "missing_count":
            out = F.count_if(c[0].isNull())
        case "missing_percent":
            out = F.round(100 * F.count_if(c[0].isNull()) / F.nullif(F.count("*"), F.lit(0)), 4)
        case "duplicate_percent":
            out = F.round(100 * (F.count("*") - F.count_distinct(F.struct(*c))) / F.nullif(F.count("*"), F.lit(0)), 4)
        case "min" | "max" | "avg" | "sum":
            out = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum}[check.metric](c[0])
        case "invalid_count":
            out = F.count_if(c[0].isNotNull() & ~c[0].isin(check.valid or []))
        case "freshness_days":
            when = F.lit(now).cast("timestamp") if now else F.current_timestamp()
            out = F.round((F.unix_micros(when) - F.unix_micros(F.max(c[0]).cast("timestamp"))) / 86_400_000_000, 4)
        case "duplicate_count":
            return None
        case other:
            raise ValueError(f"unknown metric {other}")
    return out.cast("double")


def measure(rows: DataFrame, checks: list[Check], now: str | None = None) -> list[tuple[Check, float | None]]:
    plain = [(i, m) for i, c in enumerate(checks) if (m := _metric(c, now)) is not None]
    got = rows.agg(*[m.alias(f"m{i}") for i, m in plain]).first() if plain else None
    values: list[float | None] = []
    for i, c in enumerate(checks):
        if c.metric == "duplicate_count":
            values.append(float(rows.groupBy(*c.columns).count().filter("count > 1").count()))
        else:
            values.append(got[f"m{i}"])
    return list(zip(checks, values, strict=True))


def run(rows: DataFrame, checks: list[Check], now: str | None = None) -> DataFrame:
    """metric, columns, value, outcome (pass, warn or fail; a metric without a value fails its conditions)."""
    out = [(c.metric, ",".join(c.columns), v, "fail" if _meets(c.fail, v) else "warn" if _meets(c.warn, v) else "pass") for c, v in measure(rows, checks, now)]
    return rows.sparkSession.createDataFrame(out, "metric string, columns string, value double, outcome string")


def required_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    have = set(rows.columns)
    return rows.sparkSession.createDataFrame([(n, n in have) for n in names], "column_name string, present boolean")


def schema_suite(rows: DataFrame, names: list[str]) -> DataFrame:
    """The same as checks of a gate: a column that is not there fails."""
    have = set(rows.columns)
    out = [("required_column", n, float(n in have), "pass" if n in have else "fail") for n in names]
    return rows.sparkSession.createDataFrame(out, "metric string, columns string, value double, outcome string")


def user_sql(rows: DataFrame, sql: str, expected) -> DataFrame:
    """A query of one value over ``{rows}``, held against what is expected."""
    got = rows.sparkSession.sql(sql, rows=rows)
    return got.select(F.col(got.columns[0]).alias("value"), (F.col(got.columns[0]) == F.lit(expected)).alias("passed"))


def null_profile(rows: DataFrame) -> DataFrame:
    """Nulls of every column, in one pass."""
    r = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]).first()
    out = [(c, r[c], round(100 * r[c] / r["_n"], 4) if r["_n"] else None) for c in rows.columns]
    return rows.sparkSession.createDataFrame(out, "column_name string, nulls long, null_pct double")


def trailing_volume(rows: DataFrame, at: str, days: int = 3) -> DataFrame:
    """Rows of each day and their mean over the days before."""
    daily = rows.groupBy(F.col(at).cast("date").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("mean_before", F.round(F.avg("n").over(Window.orderBy("day").rowsBetween(-days, -1)), 4))  # a row for each day


# -- generic tests: each returns the rows that violate it


def not_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull())


def unique(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def accepted_values(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.filter(~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values without a parent; aggregated before the join, so a hot value is one row of it."""
    own = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return own.join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def gate(suites: dict[str, Callable[[], DataFrame]], report: str | None = None) -> tuple[int, dict]:
    """Run suites of checks; exit code 1 if a check fails or a suite breaks, and a report that may be written as JSON."""
    out: dict = {"suites": {}, "failed": []}
    for name, suite in suites.items():
        try:
            rows = [r.asDict() for r in suite().collect()]
            bad = [r for r in rows if r.get("outcome") == "fail"]
            out["suites"][name] = {"status": "FAIL" if bad else "PASS", "checks": rows}
        except Exception as e:  # a broken suite is a failed one
            bad, out["suites"][name] = [name], {"status": "ERROR", "error": str(e)[:500]}
        if bad:
            out["failed"].append(name)
    if report:
        Path(report).write_text(json.dumps(out, indent=2, default=str))
    return int(bool(out["failed"])), out
