"""Reconciliation between layers, and invariants that return what violates them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.table import Table


@dataclass(frozen=True)
class Pair:
    """One value on either side; at_least: the source may exceed the target."""

    name: str
    source: DataFrame
    target: DataFrame
    at_least: bool = False


def compare(spark: SparkSession, pairs: list[Pair]) -> DataFrame:
    """check_name, source_value, target_value, drift (source - target), status. A side that can't be queried gives SKIP with values of -1."""
    rows = []
    for p in pairs:
        try:
            a, b = (float(x.first()[0] or 0) for x in (p.source, p.target))
            drift = round(a - b, 2)
            rows.append((p.name, a, b, drift, "PASS" if drift == 0 or (p.at_least and drift > 0) else "FAIL"))
        except Exception:  # a missing table is not a drift
            rows.append((p.name, -1.0, -1.0, 0.0, "SKIP"))
    return spark.createDataFrame(rows, "check_name string, source_value double, target_value double, drift double, status string")


def record(table: Table, results: DataFrame, now: datetime, folder: str | None = None) -> str:
    """Append the results to an audit table, and write them as JSON too where a folder is given; returns the run's id."""
    run = uuid.uuid4().hex[:8]
    table.append(results.select(F.lit(run).alias("run_id"), "*", F.lit(now).alias("executed_at")))
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        rows = [r.asDict() for r in results.collect()]
        (Path(folder) / f"reconciliation_{run}.json").write_text(json.dumps({"run_id": run, "executed_at": now.isoformat(), "results": rows}, indent=2))
    return run


def exit_code(results: DataFrame) -> int:
    return int(not results.filter("status = 'FAIL'").isEmpty())


def unique_grain(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def count_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with both counts where they differ, else none."""
    a, b = before.agg(F.count("*").alias("before")), after.agg(F.count("*").alias("after"))
    return a.join(F.broadcast(b)).filter("before <> after")
