"""Landing, marts and sessions as streams that are started, killed and started again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tarnlake.plans.lake import Lake
from tarnlake.streaming import landing
from tarnlake.streaming import events as streams
from test_daily import _by_models, _mart
from test_lake import NOW, csv, event


def test_a_second_start_reads_no_file(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "ingested_date=2024-01-10" / "a.csv", [event(1), event(2), event(3, price="NOT_A_NUMBER")])
    csv(tmp_path / "raw" / "ingested_date=2024-01-11" / "b.csv", [event(4), ("bad time", "view", 1, 5, "", "", 1.0, 7, "s")])
    first = landing.land(lake, str(tmp_path / "raw"), NOW, files_per_batch=1)
    assert first == {"rows": 5, "valid": 3, "quarantined": 2}
    assert landing.land(lake, str(tmp_path / "raw"), NOW) == {"rows": 0, "valid": 0, "quarantined": 0}
    csv(tmp_path / "raw" / "ingested_date=2024-01-12" / "c.csv", [event(5)])
    assert landing.land(lake, str(tmp_path / "raw"), NOW)["valid"] == 1
    bronze = lake.table("bronze").read()
    assert bronze.count() == 4 and {r[0].rsplit("/", 1)[1] for r in bronze.select("source_file").collect()} == {"a.csv", "b.csv", "c.csv"}
    assert spark.read.parquet(str(tmp_path / "lake" / "quarantine")).count() == 2


def test_a_batch_played_again_is_written_once(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "a.csv", [event(1), event(2), event(3, price="x")])
    mark = landing.Batches.mark
    monkeypatch.setattr(landing.Batches, "mark", lambda *a: 1 / 0)  # dies after Bronze, before the batch is marked
    with pytest.raises(Exception, match="division"):
        landing.land(lake, str(tmp_path / "raw"), NOW)
    monkeypatch.setattr(landing.Batches, "mark", mark)
    landing.land(lake, str(tmp_path / "raw"), NOW)
    assert lake.table("bronze").read().count() == 2 and spark.read.parquet(str(tmp_path / "lake" / "quarantine")).count() == 1


def test_marts_of_a_stream_killed_between_its_writes(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "a.csv", [event(1, code=None), event(2, kind="purchase"), event(2, product=3, code="z", session=None)])
    landing.land(lake, str(tmp_path / "raw"), NOW)
    run = lambda: landing.marts(lake, landing.bronze_stream(lake), NOW)
    assert run() == 2 and _mart(lake) == _by_models(lake)
    csv(tmp_path / "raw" / "late.csv", [event(5, code="c.d"), event(1, hour=3, kind="purchase", price=2.5, code=None)])
    landing.land(lake, str(tmp_path / "raw"), NOW)
    before = _mart(lake)
    monkeypatch.setenv("TARNLAKE_CRASH", "between")
    with pytest.raises(Exception, match="between the two"):
        run()
    assert lake.table("silver").read().count() == 4 and _mart(lake) == before
    monkeypatch.delenv("TARNLAKE_CRASH")
    assert run() == 0 and _mart(lake) == _by_models(lake) != before
    assert [r[1] for r in _mart(lake)] == ["c", "a", "c"]
    told = {(r["layer"], r["duplicate_rate_pct"], r["null_rate_pct"], r["watermark_lag_sec"]) for r in lake.table("pipeline_metrics").read().collect()}
    assert ("silver", 0.0, 33.3333, 30 * 86400) in told


def test_sessions_of_a_disordered_stream(spark, tmp_path):
    rng = random.Random(5)
    times = [datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 6)) for _ in range(400)] + [datetime(2024, 1, 1) + timedelta(minutes=30 * i) for i in range(5)]
    rows = [(rng.randrange(4), at) for at in times]
    rows += [(9, datetime(2024, 1, 2, 10, 0)), (9, datetime(2024, 1, 2, 11, 0)), (9, datetime(2024, 1, 2, 10, 30))]  # the last joins two sessions
    arrival = sorted(rows, key=lambda r: (r[1] + timedelta(hours=rng.randrange(40)) if r[0] != 9 else datetime(2024, 1, 2, {600: 12, 660: 13, 630: 14}[60 * r[1].hour + r[1].minute])))
    src = tmp_path / "src"
    for i in range(0, len(arrival), 60):
        spark.createDataFrame(arrival[i : i + 60], "user_id long, event_time timestamp").coalesce(1).write.mode("append").parquet(str(src))
    want = sorted(map(tuple, streams.session_windows(spark.createDataFrame(rows, "user_id long, event_time timestamp")).collect()))
    out = lambda: sorted(map(tuple, streams.session_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "c"), files_per_batch=1).read().collect()))
    first = out()
    assert 0 < len(first) < len(want) and set(first) <= set(want)  # the last days' sessions may still grow
    assert out() == first
    for day in (1, 2):  # the watermark that a batch brings holds from the next one on
        spark.createDataFrame([(None, datetime(2025, 1, day))], "user_id long, event_time timestamp").coalesce(1).write.mode("append").parquet(str(src))
    assert out() == want
