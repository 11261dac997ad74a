"""Versioned data contracts: loading, comparing, validating, and a registry."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.table import Table

REGISTRY = "dataset_name string, version string, owner string, compatibility_status string, sla_max_latency_hours int, last_validated_at timestamp, validation_status string, active_flag boolean"
_TYPES = {"bigint": "long", "int": "integer", "timestamp_ntz": "timestamp"}


def load(path: str, spark: SparkSession | None = None) -> dict:
    """A contract from YAML, or from JSON where YAML cannot be read here; with a session from any store, else a local file."""
    if spark is not None:
        text = store.read(spark, path)
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def diff(old: dict, new: dict) -> dict:
    """Changes from one version to the next: BREAKING if any drops or narrows what readers rely on, else COMPATIBLE."""
    before, after = old.get("columns", {}), new.get("columns", {})
    changes = []
    for name in [*before, *(n for n in after if n not in before)]:
        a, b = before.get(name), after.get(name)
        if b is None:
            changes.append(("COLUMN_DROPPED", name))
        elif a is None:
            changes.append(("REQUIRED_COLUMN_ADDED" if b.get("required", False) else "OPTIONAL_COLUMN_ADDED", name))
        else:
            if a.get("type") != b.get("type"):
                changes.append(("TYPE_CHANGED", name))
            if a.get("nullable", True) and not b.get("nullable", True):
                changes.append(("NULLABILITY_TIGHTENED", name))
    told = [{"type": t, "column": n, "severity": "COMPATIBLE" if t == "OPTIONAL_COLUMN_ADDED" else "BREAKING"} for t, n in changes]
    return {"overall_status": "BREAKING" if any(c["severity"] == "BREAKING" for c in told) else "COMPATIBLE", "changes": told}


def violations(rows: DataFrame, contract: dict, strict: bool = False, now: datetime | None = None) -> DataFrame:
    """rule, column_name, violations of the rows, from one pass. Blank text counts as null.

    strict also checks types, allowed values and minima; text is held against a type by whether it can be
    cast, and minima compare what was cast. With ``now`` a contract's ``sla`` (max_latency_hours, column) is
    checked too: the newest row may be so old.
    """
    spark, have = rows.sparkSession, dict(rows.dtypes)
    out, aggs = [], []
    for name, spec in contract.get("columns", {}).items():
        if name not in have:
            if spec.get("required", False):
                out.append(("missing_required_column", name, 1))
            continue
        c = F.col(name)
        if not spec.get("nullable", True):
            blank = c.isNull() | (F.trim(c) == "") if have[name] == "string" else c.isNull()
            aggs.append(("null_in_non_nullable_column", name, F.count_if(blank)))
        value, kind = c, _TYPES.get(spec.get("type"), spec.get("type"))
        if strict and kind and have[name] == "string" and kind != "string":
            value = F.when(F.trim(c) != "", c).try_cast(kind)
            aggs.append(("type_mismatch", name, F.count_if((F.trim(c) != "") & value.isNull())))
        elif strict and kind and _TYPES.get(have[name], have[name]) != kind:
            out.append(("type_mismatch", name, 1))
        if strict and spec.get("allowed_values"):
            aggs.append(("value_not_allowed", name, F.count_if(c.isNotNull() & ~c.isin(spec["allowed_values"]))))
        if strict and spec.get("min_value") is not None:
            aggs.append(("value_below_minimum", name, F.count_if((value if have[name] != "string" or kind != "string" else c.try_cast("double")) < spec["min_value"])))
    sla = contract.get("sla") or {}
    if now and sla.get("max_latency_hours") is not None and (at := sla.get("column", "ingested_at")) in have:
        newest = F.unix_micros(F.max(F.col(at).try_cast("timestamp") if have[at] == "string" else F.col(at).cast("timestamp")))
        late = F.unix_micros(F.lit(now.isoformat(sep=" ")).cast("timestamp")) - newest > sla["max_latency_hours"] * 3_600_000_000
        aggs.append(("sla_exceeded", at, F.coalesce(late, F.lit(False)).cast("long")))
    if aggs:
        got = rows.agg(*[a.alias(f"a{i}") for i, (_, _, a) in enumerate(aggs)]).first()
        out += [(rule, name, got[i]) for i, (rule, name, _) in enumerate(aggs) if got[i]]
    return spark.createDataFrame(out, "rule string, column_name string, violations long")


def validate_csv(spark: SparkSession, path: str, contract: dict, strict: bool = False, now: datetime | None = None) -> dict:
    """valid, violations and rows_checked of a CSV file with a header; all values are read as text."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    found = [r.asDict() for r in violations(rows, contract, strict, now).collect()]
    return {"valid": not found, "violations": found, "rows_checked": rows.count()}


def quarantine(spark: SparkSession, path: str, found: list[dict], folder: str, now: datetime | None = None) -> str:
    """Move a violating file aside, to whatever store, with its violations as JSON beside it."""
    now = now or datetime.now(UTC)
    target = f"{store.make(spark, folder.rstrip('/'))}/{now:%Y%m%d_%H%M%S}_{path.rstrip('/').rsplit('/', 1)[-1]}"
    store.write(spark, f"{target}.json", json.dumps({"source_file": path, "quarantined_at": now.isoformat(), "violations": found}, indent=2))
    store.retrying(lambda: store.copy(spark, path, target, move=True))
    return f"{target}.json"


def register(registry: Table, contract: dict, status: str, validation: str, now: datetime) -> None:
    """Enter a version; the dataset's earlier versions become inactive."""
    spark = registry.spark
    row = (contract["dataset_name"], str(contract["version"]), contract.get("owner"), status, contract.get("sla", {}).get("max_latency_hours"), now, validation, True)
    new = spark.createDataFrame([row], REGISTRY)
    if registry.exists():
        old = registry.read().filter(~((F.col("dataset_name") == row[0]) & (F.col("version") == row[1])))
        new = old.withColumn("active_flag", F.col("active_flag") & (F.col("dataset_name") != row[0])).unionByName(new)
    registry.overwrite(new)


def listing(registry: Table, dataset: str | None = None, active_only: bool = False) -> DataFrame:
    """The versions entered, the newest first; of one dataset where it is named."""
    spark = registry.spark
    rows = registry.read() if registry.exists() else spark.createDataFrame([], REGISTRY)
    rows = rows if dataset is None else rows.filter(F.col("dataset_name") == dataset)
    return (rows.filter("active_flag") if active_only else rows).orderBy("dataset_name", F.desc("last_validated_at"), F.desc("version"))
