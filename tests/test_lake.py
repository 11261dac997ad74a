import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tarnlake.plans.lake import Lake
from tarnlake.plans.registry import Registry, from_manifest, lineage_event
from tarnlake.plans.replay import days_between, replay, status_of
from tarnlake.sources import raw, store
from tarnlake.sources.table import CommitConflict, Table

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
NOW = datetime(2024, 2, 1)


def csv(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEADER + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows))
    return str(path)


def event(day, hour=0, kind="view", product=1, code="a.b", price=9.5, user=7, session="s"):
    return (f"2024-01-{day:02d} {hour:02d}:00:00 UTC", kind, product, 5, code, "x", price, user, session)


def test_quarantine(spark, tmp_path):
    path = csv(tmp_path / "in" / "a.csv", [event(1), event(2), event(3, price="NOT_A_NUMBER", code=None), event(4), ("bad time", "view", 1, 5, "", "", 1.0, 7, "s"), ("2024-01-05 00:00:00 UTC", "view")])
    valid, bad, counts = raw.split_corrupt(raw.read_csv(spark, path))
    assert counts == {"rows": 6, "valid": 3, "quarantined": 3, "quarantine_pct": 50.0}
    assert valid.count() == 3 and bad.filter("_corrupt_record IS NOT NULL").count() == 3
    assert raw.write_quarantine(bad, str(tmp_path / "q"), "b1") and raw.write_quarantine(bad.limit(0), str(tmp_path / "q"), "b2") is None


def test_landing_and_incremental_silver(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "ingested_date=2024-01-10" / "a.csv", [event(1), event(1), event(2, kind="purchase"), event(9, session=None), event(9, price=-1)])
    assert lake.land(str(tmp_path / "raw"), NOW)["valid"] == 5
    assert lake.land(str(tmp_path / "raw"), NOW)["rows"] == 0  # the file is known
    assert lake.watermark() is None
    first = lake.refine(NOW)
    assert (first["rows_out"], first["inserted"]) == (3, 2)
    assert lake.watermark() == datetime(2024, 1, 2)
    assert lake.refine(NOW)["inserted"] == 0
    csv(tmp_path / "raw" / "ingested_date=2024-01-11" / "b.csv", [event(1, hour=5), event(3)])
    lake.land(str(tmp_path / "raw"), NOW)
    assert lake.refine(NOW)["inserted"] == 2
    silver = lake.table("silver").read()
    assert silver.count() == silver.select("event_key").distinct().count() == 4
    assert lake.rebuild_daily(NOW) == 3
    full = sorted(map(str, lake.table("mart_daily_summary").read().drop("last_recomputed_at").collect()))
    csv(tmp_path / "raw" / "ingested_date=2024-01-12" / "c.csv", [event(2, hour=9, kind="purchase"), event(2, hour=9, product=3, code="z")])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    assert lake.rebuild_daily(datetime(2024, 2, 2)) == 2  # two categories of one day
    after = sorted(map(str, lake.table("mart_daily_summary").read().drop("last_recomputed_at").collect()))
    assert after != full
    lake.rebuild_daily(datetime(2024, 2, 3), full=True)
    assert sorted(map(str, lake.table("mart_daily_summary").read().drop("last_recomputed_at").collect())) == after
    assert lake.rebuild_daily(NOW) == 0


def test_crash_after_merge_is_repaired(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "ingested_date=2024-01-10" / "a.csv", [event(1), event(2)])
    lake.land(str(tmp_path / "raw"), NOW)
    monkeypatch.setenv("TARNLAKE_CRASH", "true")
    with pytest.raises(RuntimeError, match="crash"):
        lake.refine(NOW)
    monkeypatch.delenv("TARNLAKE_CRASH")
    assert lake.watermark() is None and lake.table("silver").read().count() == 2
    assert lake.refine(NOW)["inserted"] == 0
    assert lake.watermark() == datetime(2024, 1, 2)


def test_replay_leaves_the_watermark(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "ingested_date=2024-01-10" / "a.csv", [event(20)])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    csv(tmp_path / "raw" / "ingested_date=2024-01-11" / "b.csv", [event(1, hour=13, kind="purchase")])
    lake.land(str(tmp_path / "raw"), NOW)
    before = lake.watermark()
    lake.rebuild_daily(NOW)
    assert replay(lake, "backfill", "2024-01-01", "2024-01-01", dry_run=True)["status"] == "DRY_RUN"
    out = replay(lake, "backfill", "2024-01-01", "2024-01-01", now=NOW, folder=str(tmp_path / "audit"))
    assert (out["status"], out["rows_inserted"]) == ("SUCCESS", 1)
    assert lake.watermark() == before
    assert lake.table("mart_daily_summary").read().filter("date = DATE '2024-01-01'").first()["total_purchases"] == 1
    assert lake.table("replay_audit").read().count() == 1 and len(os.listdir(tmp_path / "audit")) == 1
    assert [status_of(*s) for s in (("SUCCESS", "SUCCESS"), ("FAILED", "SUCCESS"), ("SUCCESS", "SKIPPED_NOT_REQUIRED"))] == ["SUCCESS", "FAILED", "PARTIAL"]
    assert days_between("2024-01-30", "2024-02-01") == ["2024-01-30", "2024-01-31", "2024-02-01"]


def test_table_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    assert not t.exists() and t.create_or_get(df.filter("id < 5"), ["id"]) and not t.create_or_get(df)
    t.append(df.filter("id >= 5"))
    assert t.append(df.limit(0)) is None
    t.replace_keys(spark.createDataFrame([(1, 100)], "id long, v long"), ["id"])
    assert t.read().filter("id = 1").first()["v"] == 100 and t.read().count() == 10
    assert t.read(version=0).count() == 5
    with pytest.raises(ValueError, match="no version"):
        t.read(version=99)
    assert [r["operation"] for r in t.history().collect()] == ["REPLACE", "APPEND", "CREATE"]
    t.append(spark.createDataFrame([(50, 1, "new")], "id long, v long, more string"))
    assert t.read().filter("more IS NULL").count() == 10
    with pytest.raises(ValueError, match="column v"):
        t.append(spark.createDataFrame([(1, "x")], "id long, v string"))


def test_two_writers_of_one_version(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(spark.range(3))
    first = t._commit
    lost = []

    def racing(*args):
        if not lost:
            lost.append(1)
            Table(spark, t.path).append(spark.range(3, 5).toDF("id"))
            assert t.version() == 1
        return first(*args)

    t._commit = racing
    t.merge_insert(spark.range(0, 8).toDF("id"), ["id"])
    assert sorted(r["id"] for r in t.read().collect()) == list(range(8))
    with pytest.raises(CommitConflict):
        first("APPEND", [], [], t.schema(), {}, 0, [])


def test_zorder_skips_files(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 1000).alias("a"), (F.col("id") * 104729 % 1000).alias("b"))
    t.append(df)
    t.optimize(["a", "b"], files=16)
    got = t.read(bounds={"a": (0, 100)})
    assert got.count() == df.filter("a <= 100").count()
    assert len(got.inputFiles()) < 16


def test_registry(tmp_path, spark):
    r = Registry()
    r.model("a", "staging")(lambda: spark.range(2))
    r.model("b", "core", ("a",))(lambda a: a.filter("id > 0"))
    r.exposures["board"] = ("b",)
    assert r.order() == ["a", "b"] and r.select("+exposure:board") == ["a", "b"] and r.select("layer:core") == ["b"] and r.select("a+") == ["a", "b"]
    with pytest.raises(ValueError, match="nothing is named"):
        r.select("zzz")
    assert r.graph()["layers"] == {"staging": 1, "core": 1, "exposure": 1}
    waits, told = [], []
    r.model("c", "core", ("b",))(lambda b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        r.run(["c"], retries=2, sleep=waits.append, on_failure=lambda n, e: told.append(n))
    assert waits == [120, 240] and told == ["c"]
    manifest = {"nodes": {"m.x": {"name": "x", "resource_type": "model", "depends_on": {"nodes": ["s.y", "gone"]}}, "t.z": {"resource_type": "test"}}, "sources": {"s.y": {"name": "y"}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert from_manifest(str(tmp_path / "m.json"))["links"] == [{"source": "s.y", "target": "m.x"}]
    told = lineage_event("job", [spark.range(1)], spark.range(1), "out", sink=str(tmp_path / "l.jsonl"))
    assert json.loads((tmp_path / "l.jsonl").read_text())["run"] == told["run"]


def test_ingest_and_listing(spark, tmp_path):
    src = csv(tmp_path / "src" / "a.csv", [event(1)])
    folder = raw.ingest(spark, [f"file:{src}"], str(tmp_path / "raw"), "2024-01-01")
    assert json.loads(open(f"{folder}/_SUCCESS").read())["files"] == ["a.csv"]
    rows = raw.listing(spark, str(tmp_path / "raw"), "*.csv").collect()
    assert [(r["partition"], r["length"] > 0) for r in rows] == [("ingested_date=2024-01-01", True)]
    checks = {c["check"]: c["passed"] for c in raw.structural_checks(spark, str(tmp_path / "raw"), datetime.now(), min_bytes=10)}
    assert all(checks.values())
    assert not any(c["passed"] for c in raw.structural_checks(spark, str(tmp_path / "none"), datetime.now()))
    assert raw.head_sample(spark, f"file:{src}", f"file:{tmp_path}/head.csv", 1) == 1 and open(tmp_path / "head.csv").read() == HEADER
    assert len(raw.create_zones(spark, f"file:{tmp_path}/zones")) == 6
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert store.retrying(flaky, sleep=waits.append) == "ok" and waits == [2, 4, 8]


def test_reconciliation_counts_all_raw_files(spark, tmp_path):
    """Folders below others, names that are encoded, and files that were never landed."""
    lake = Lake(spark, str(tmp_path / "lake"))
    for day, folder in enumerate((".", "a b+c", "a b+c/deep", "d%20e", "."), 1):
        csv(tmp_path / "raw" / folder / f"{day}.csv", [event(day), event(day, hour=1, kind="purchase")])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    csv(tmp_path / "raw" / "later.csv", [event(9)])
    got = {r["check_name"]: r for r in lake.reconcile().collect()}["raw_vs_bronze"]
    assert (got["source_value"], got["target_value"], got["status"]) == (10.0, 10.0, "PASS")
    counts = raw.rows_of(spark, lake.table("bronze").read().select("source_file"))
    assert sorted(r["n"] for r in counts.collect()) == [2] * 5
    assert raw.rows_of(spark, spark.createDataFrame([(None,)], "f string")).count() == 0


def test_landings_read_only_new_entries_of_the_log(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    loaded, load = [], Table._load
    monkeypatch.setattr("tarnlake.plans.lake.NOTES", 3)
    monkeypatch.setattr(Table, "_load", lambda self, v: (loaded.append((self.path.rsplit("/", 1)[-1], v)), load(self, v))[1])
    for day in range(1, 6):
        csv(tmp_path / "raw" / f"{day}.csv", [event(day)])
        loaded.clear()
        assert lake.land(str(tmp_path / "raw"), NOW)["rows"] == 1
        assert all(v >= day - 2 for name, v in loaded if name == "bronze")
    bronze = lake.table("bronze")
    assert bronze.read().count() == 5 and lake.land(str(tmp_path / "raw"), NOW)["rows"] == 0
    # a run that died between a commit and its note: the log decides
    csv(tmp_path / "raw" / "6.csv", [event(6)])
    bronze.append(bronze.read().limit(0), metrics={"files": [f for f in raw.files(spark, str(tmp_path / "raw")) if f.endswith("6.csv")]})
    assert lake.land(str(tmp_path / "raw"), NOW)["rows"] == 0
    told = lake.landed().read()
    assert told.count() == 6 and told.filter("bronze_version = 5").first()["file"].endswith("6.csv")
    assert len(lake.landed().files()) <= 4
