import json
import logging
from datetime import datetime

import pytest
from tarnlake.quality import checks, contracts, metrics, reconcile
from tarnlake.sources import store
from tarnlake.sources.table import Table


def spec(**columns):
    return {"dataset_name": "d", "version": "1", "columns": columns}


def test_contract_diff():
    old = spec(a={"type": "long"}, b={"type": "string", "nullable": True})
    assert contracts.diff(old, spec(**old["columns"], c={"type": "string"}))["overall_status"] == "COMPATIBLE"
    for new in (spec(a={"type": "long"}), spec(a={"type": "string"}, b=old["columns"]["b"]), spec(a={"type": "long"}, b={"type": "string", "nullable": False}), spec(**old["columns"], c={"type": "long", "required": True})):
        assert contracts.diff(old, new)["overall_status"] == "BREAKING"


def test_contract_files(spark, tmp_path):
    (tmp_path / "c.yml").write_text("dataset_name: d\nversion: '1'\ncolumns:\n  a: {type: string, required: true, nullable: false}\n  z: {required: true}\n")
    contract = contracts.load(str(tmp_path / "c.yml"))
    (tmp_path / "d.csv").write_text("a,b\n1,2\n ,3\n")
    out = contracts.validate_csv(spark, str(tmp_path / "d.csv"), contract)
    assert not out["valid"] and {v["rule"] for v in out["violations"]} == {"missing_required_column", "null_in_non_nullable_column"}
    meta = contracts.quarantine(spark, f"file:{tmp_path}/d.csv", out["violations"], f"file:{tmp_path}/q")
    assert json.loads(store.read(spark, meta))["violations"] and not (tmp_path / "d.csv").exists()
    registry = Table(spark, str(tmp_path / "r"))
    for v in ("1", "2", "2"):
        contracts.register(registry, contract | {"version": v}, "COMPATIBLE", "PASS", datetime(2024, 1, 1))
    assert sorted((r["version"], r["active_flag"]) for r in registry.read().collect()) == [("1", False), ("2", True)]


def test_gate(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    good = lambda: checks.run(rows, [checks.Check("row_count", fail="< 1")])
    bad = lambda: checks.run(rows, [checks.Check("missing_count", ["v"], fail="> 0"), checks.Check("duplicate_count", ["k"], warn="> 0")])
    assert checks.gate({"a": good}) [0] == 0
    code, report = checks.gate({"a": good, "b": bad, "c": lambda: 1 / 0}, str(tmp_path / "r.json"))
    assert code == 1 and report["failed"] == ["b", "c"] and report["suites"]["c"]["status"] == "ERROR"
    assert json.loads((tmp_path / "r.json").read_text())["failed"] == ["b", "c"]
    assert [r["outcome"] for r in bad().collect()] == ["fail", "warn"]
    with pytest.raises(ValueError, match="unknown metric"):
        checks.run(rows, [checks.Check("nonsense")])


def test_reconcile_skip_and_fail(spark):
    one, two = spark.range(1).groupBy().count(), spark.range(2).groupBy().count()
    broken = spark.range(1).selectExpr("raise_error('gone') AS x")
    got = {r["check_name"]: r["status"] for r in reconcile.compare(spark, [reconcile.Pair("a", one, one), reconcile.Pair("b", one, two), reconcile.Pair("c", broken, one), reconcile.Pair("d", two, one, at_least=True)]).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "SKIP", "d": "PASS"}


def test_metrics(spark, tmp_path):
    t = Table(spark, str(tmp_path / "m"))
    assert metrics.record(t, "silver", 10, 9, 2.0, folder=str(tmp_path / "a"))["throughput_rows_sec"] == 4.5
    assert metrics.record(t, "silver", 10, 9, 0.0)["throughput_rows_sec"] == 9
    assert t.read().count() == 2
    rows, seen = metrics.observed(spark.range(5))
    rows.write.parquet(str(tmp_path / "o"))
    assert seen.get["n"] == 5
    line = metrics.JsonFormatter().format(logging.makeLogRecord({"msg": "x", "levelname": "INFO", "rows": 3}))
    assert json.loads(line)["rows"] == 3
