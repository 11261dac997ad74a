"""Alerts, logs, lineage and stores: what a run tells, and where it may lie."""

import io
import json
import logging

import pytest
from pyspark.sql import functions as F
from tarnlake import __main__ as cli
from tarnlake.operators import dimensions, facts
from tarnlake.plans.lake import Lake
from tarnlake.quality import alerts, metrics
from tarnlake.sources import store
from tarnlake.sources.table import Table
from test_lake import NOW, csv, event


def test_alerts_go_on_to_the_next_channel(spark, tmp_path, caplog):
    kept = Table(spark, str(tmp_path / "alerts"))
    assert alerts.in_turn(alerts.webhook("http://127.0.0.1:9/none", 0.2), alerts.to_table(kept), now=lambda: NOW)("job", ValueError("bad")) == "1"
    assert [(r["task"], r["error"]) for r in kept.read().collect()] == [("job", "ValueError: bad")]
    taken = []
    assert alerts.in_turn(taken.append, lambda a: pytest.fail("not asked"), now=lambda: NOW)("job", ValueError("bad")) == "0" and taken[0]["task"] == "job"
    assert alerts.in_turn(lambda a: 1 / 0)("job", ValueError("bad")) == "log"


def test_a_failed_model_is_alerted(spark, tmp_path, capsys, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "a.csv", [event(1), event(2, kind="purchase")])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    monkeypatch.setattr(Lake, "materialise", lambda *a: 1 / 0)
    assert cli.main(["run", lake.root, "--select", "dim_date", "--retries", "0"]) == 1
    assert json.loads(capsys.readouterr().out)["failed"][0]["alerted"] == "0" and lake.table("alerts").read().count() == 1


def test_runs_tell_of_themselves(spark, tmp_path):
    out = io.StringIO()
    metrics.json_logs(stream=out)
    try:
        lake = Lake(spark, str(tmp_path / "lake"))
        csv(tmp_path / "raw" / "a.csv", [event(1), event(1), event(2, kind="purchase"), event(3, session=None), event(3, price="x")])
        lake.land(str(tmp_path / "raw"), NOW)
        lake.refine(NOW)
        lake.refine(NOW)
        lake.rebuild_daily(NOW)
    finally:
        logging.getLogger("tarnlake").handlers.clear()
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t["layer"] for t in told] == ["bronze", "silver", "silver", "gold"]
    figures = [(t["quarantined_rows"], t["null_rate_pct"], t["duplicate_rate_pct"], t["watermark_lag_sec"]) for t in told]
    assert figures == [(1, 20.0, 0.0, 0), (0, 25.0, 33.3333, 30 * 86400), (0, 25.0, 0.0, 30 * 86400), (0, 0.0, 0.0, 30 * 86400)]
    lineage = lake.table("lineage_events").read().orderBy("output", "output_version").collect()
    assert [(r["job"], r["inputs"], r["output"], r["output_version"]) for r in lineage][-1] == ("silver", ["bronze@0"], "silver", 0)
    assert {r["output"] for r in lineage} == {"bronze", "silver", "mart_daily_summary"} and "event_key" in {f["name"] for f in lineage[-1]["fields"]}


def test_a_merge_that_wrote_other_rows_is_found(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "event_key string")
    commit = lake.table("silver").append(rows)
    with pytest.raises(RuntimeError, match="3 rows of 2 keys"):
        lake._verified(commit, rows)
    commit = lake.table("other").append(rows.limit(1))
    lake.table("silver").append(rows.limit(1))
    with pytest.raises(RuntimeError, match="0 of them of the batch"):
        lake._verified(lake.table("silver").commits()[-1], rows.filter("event_key = 'c'"))


def test_the_star_is_stored_once_for_a_version(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), hot_rows=2)
    csv(tmp_path / "raw" / "a.csv", [event(1), event(2, kind="purchase"), event(2, hour=3, product=2, user=8, price=1)])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    found = lambda: sorted(map(str, lake.star()[0].drop("ingested_at").collect()))
    first, version = found(), lake.table("int_events_enriched").version()
    assert len(first) == 3 and found() == first and lake.table("int_events_enriched").version() == version
    assert sorted(map(str, Lake(spark, lake.root).star()[0].drop("ingested_at").collect())) == first  # nothing is hot
    csv(tmp_path / "raw" / "b.csv", [event(3)])
    lake.land(str(tmp_path / "raw"), NOW)
    lake.refine(NOW)
    assert len(found()) == 4 and lake.table("int_events_enriched").version() == version + 1


def test_copies_between_stores(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nzwei é\n")
    store.copy(spark, f"file:{tmp_path}/a.txt", f"{tmp_path}/b.txt")
    store.copy(spark, f"{tmp_path}/a.txt", f"file:{tmp_path}/b.txt", move=True)
    assert store.read(spark, f"file:{tmp_path}/b.txt") == "one\nzwei é\n" and store.lines(spark, f"{tmp_path}/b.txt", 1) == ["one"] and not (tmp_path / "a.txt").exists()
    waits = []
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        store.retrying(lambda: store.size(spark, f"{tmp_path}/none"), attempts=3, sleep=waits.append)
    assert waits == [2, 4]
    with pytest.raises(ValueError):
        store.retrying(lambda: int("x"), sleep=lambda s: pytest.fail("no failure of output"))


def test_bitmaps_count_distinct_ids(spark):
    rows = spark.createDataFrame([(d, u) for d in range(4) for u in (None, -5, 0, 1, 32768, 32769, 10**12, d, -d)], "day int, user_id long")
    days = facts.id_bitmaps(rows, ["day"])
    assert facts.distinct_ids(days.withColumn("all", F.lit(1)), ["all"]).first()["active_users"] == rows.select("user_id").distinct().count() - 1
    assert sorted(map(tuple, facts.distinct_ids(days, ["day"]).collect())) == sorted(map(tuple, rows.groupBy("day").agg(F.count_distinct("user_id")).collect()))
    bought = spark.createDataFrame([("2024-01-05", 1), ("2024-03-01", 1), ("2024-02-02", 2), ("2024-02-03", None)], "d string, user_id long").select(F.to_timestamp("d").alias("purchased_at"), "user_id", F.md5(F.col("user_id").cast("string")).alias("customer_key"))
    known = bought.filter("user_id IS NOT NULL")
    want = facts.retention(facts.cohort_grid(known, dimensions.date_dimension(spark)))
    got = facts.retention_from(facts.cohort_bitmaps(bought))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len(got.collect()) == 5
