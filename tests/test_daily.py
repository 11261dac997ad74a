"""The incremental mart equals a full run, and the mart of the catalogue's models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tarnlake.operators import cleaning, dimensions, facts, heat, joins, segments, sessions
from tarnlake.plans import daily
from tarnlake.plans.lake import Lake

NOW = datetime(2024, 2, 1)
SCHEMA = "event_time timestamp, event_type string, product_id long, price double, user_id long, category_code string, brand string"


def _silver(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return cleaning.with_event_key(cleaning.parse_category(df))


def _merge(lake, spark, rows):
    lake.table("silver").merge_insert(_silver(spark, rows), ["event_key"], ["event_date"], bounded_by="event_date")


def _mart(lake):
    rows = lake.table("mart_daily_summary").read().select("date", "category_l1", "total_events", "total_purchases", F.round("total_revenue", 6), "active_users")
    return sorted(map(tuple, rows.collect()))


def _by_models(lake):
    """The same from sessions, enrichment, versions and facts."""
    e = lake.table("silver").read()
    full = joins.enrich(sessions.sessionize(e), cleaning.latest_products(e))
    history = dimensions.product_history(full).withColumn("category", F.col("category_l1"))
    dated = joins.asof_join(full, history, "product_id", carry=["category"])
    return sorted(map(tuple, facts.daily_rollup(dated, "category").select("date", "category_l1", "total_events", "total_purchases", F.round("total_revenue", 6), "active_users").collect()))


def _event(rng, days=6, products=4):
    at = datetime(2023, 10, 1) + timedelta(days=rng.randrange(days), hours=rng.randrange(3), minutes=rng.choice([0, 0, 30]))
    return (at, rng.choice(["view", "view", "purchase"]), rng.choice([None, *range(products)]), rng.choice([1.0, 1.0, 2.0]), rng.choice([None, 1, 2, 3]), rng.choice([None, None, "a.b", "b.c", "b.d", ""]), None)


def test_a_new_category_reaches_earlier_days(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    day = lambda d, code: (datetime(2023, 10, d), "view", 1, 5.0, 7, code, None)
    _merge(lake, spark, [day(1, None), day(2, "a.b"), (datetime(2023, 10, 9), "view", 2, 5.0, 7, "x", None)])
    lake.rebuild_daily(NOW)
    assert [(r[0].day, r[1]) for r in _mart(lake)] == [(1, "a"), (2, "a"), (9, "x")]
    _merge(lake, spark, [day(5, "b.c")])
    assert lake.rebuild_daily(NOW) == 2  # the 2nd keeps its category
    assert [(r[0].day, r[1]) for r in _mart(lake)] == [(1, "b"), (2, "a"), (5, "b"), (9, "x")] == [(r[0].day, r[1]) for r in _by_models(lake)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    lake = Lake(spark, str(tmp_path / "lake"))
    for size in (25, 6, 1, 12):
        _merge(lake, spark, [_event(rng) for _ in range(size)])
        lake.rebuild_daily(NOW)
        assert _mart(lake) == _by_models(lake)
    after = lake.table("product_days").read().drop("bucket")
    stored = sorted(map(str, after.collect()))
    lake.rebuild_daily(NOW, full=True)
    assert sorted(map(str, lake.table("product_days").read().drop("bucket").collect())) == stored and _mart(lake) == _by_models(lake)


def test_only_files_with_changed_days_are_read(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _merge(lake, spark, [(datetime(2023, 10, 1) + timedelta(days=d, minutes=i), "view", d % 5, 5.0, i, "a.b", None) for d in range(30) for i in range(4)])
        lake.rebuild_daily(NOW)
        files = len(lake.table("silver").read().inputFiles())
        assert files > 1
        _merge(lake, spark, [(datetime(2023, 10, 3, 9), "view", 2, 5.0, 9, "a.b", None)])
        opened = []
        read = daily.Table.read

        def spy(self, *a, **k):
            df = read(self, *a, **k)
            if self.path.endswith("/silver"):
                opened.append(len(df.inputFiles()))
            return df

        monkeypatch.setattr(daily.Table, "read", spy)
        assert lake.rebuild_daily(NOW) == 1
        assert opened and max(opened) < files
        monkeypatch.undo()
        assert _mart(lake) == _by_models(lake)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("dies_at", ["product_days.replace_keys", "mart.replace_keys", "state.append"])
def test_a_run_that_died_is_made_good(spark, tmp_path, dies_at):
    lake = Lake(spark, str(tmp_path / "lake"))
    day = lambda d, code: (datetime(2023, 10, d), "view", 1, 5.0, 7, code, None)
    _merge(lake, spark, [day(1, None), day(2, "a.b")])
    lake.rebuild_daily(NOW)
    _merge(lake, spark, [day(5, "b.c")])
    broken = lake.daily()
    table, call = dies_at.split(".")

    def die(*a, **k):
        raise RuntimeError("died")

    setattr(getattr(broken, table), call, die)
    with pytest.raises(RuntimeError, match="died"):
        broken.rebuild(NOW)
    assert lake.rebuild_daily(NOW) == 2 and _mart(lake) == _by_models(lake)
    assert lake.rebuild_daily(NOW) == 0


def test_hot_keys_are_found_and_sliced(spark):
    rng = random.Random(4)
    rows = [_event(rng, 3, 40) for _ in range(300)] + [(datetime(2023, 10, 1) + timedelta(minutes=17 * i), "view", 99, float(i % 7 // 3), i % 5, rng.choice([None, "a.b", "c"]), None) for i in range(300)]
    e = _silver(spark, rows).dropDuplicates(["event_key"])
    assert heat.hot_keys(e, "product_id", least=100) == [99] and heat.hot_keys(e, "product_id") == [] and heat.hot_keys(e.limit(0), "product_id", least=0) == []
    assert heat.hot_keys(e.withColumn("k", F.col("product_id").cast("string")), "k", least=100) == ["99"]
    found = lambda df: sorted(map(str, df.collect()))
    assert found(segments.day_segments(e, [99])) == found(segments.day_segments(e))
    s = segments.resolved(segments.day_segments(e)).persist()
    assert found(segments.resolved(segments.day_segments(e), [99])) == found(s)
    assert found(segments.categorised(e, s, [99])) == found(segments.categorised(e, s))
    assert found(sessions.sessionize(e, slice_seconds=3600, hot=[1, 2])) == found(sessions.sessionize(e))
    history = dimensions.product_history(e)
    assert found(dimensions.product_history(e, 3600, [99])) == found(history)
    want = found(joins.asof_join(e, history, "product_id", carry=["product_version"]).select("event_key", "product_version"))
    for more in ({"slice_seconds": 3600}, {"slice_seconds": 7200, "hot": [99, 3]}, {"slice_seconds": 60, "salts": 3}):
        assert found(joins.asof_join(e, history, "product_id", carry=["product_version"], **more).select("event_key", "product_version")) == want


def test_overlapping_pairs_once_each(spark):
    rng = random.Random(7)
    at = lambda h: None if h is None else datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(p, v, at(a := rng.randrange(20)), at(rng.choice([None, a, a + 1, a + rng.randrange(1, 9)]))) for p in (1, 2, None) for v in range(25)]
    history = spark.createDataFrame(rows, "product_id long, product_version long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    far = datetime(9999, 1, 1)
    live = [r for r in rows if r[0] is not None and (r[3] or far) > r[2]]
    want = sorted((a[0], a[1], b[1]) for a in live for b in live if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and b[2] < (a[3] or far))
    pairs = dimensions.overlapping_pairs(history)
    assert sorted(map(tuple, pairs.select("product_id", "earlier", "later").collect())) == want and len(want) > 50
    assert "Cartesian" not in pairs._jdf.queryExecution().toString() and dimensions.overlapping_pairs(history.limit(0)).count() == 0


def _windows(spark, rng, n):
    at = lambda h: None if h is None else datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(p, v, at(a := rng.randrange(40)), at(rng.choice([None, a, a - 1, a + 1, a + rng.randrange(1, 12)]))) for p in (1, 2, None) for v in range(n)]
    return rows + [(1, n, None, at(5)), rows[0]], "product_id long, product_version long, valid_from timestamp_ntz, valid_to timestamp_ntz"


def test_pairs_are_made_after_the_last_shuffle(spark, monkeypatch):
    """A product's versions lie in several rows, some reach over all of them; pairs themselves are not shuffled."""
    rows, schema = _windows(spark, random.Random(8), 40)
    rows = rows[:-2]
    far = datetime(9999, 1, 1)
    live = [r for r in rows if r[0] is not None and (r[3] or far) > r[2]]
    want = sorted((a[0], a[1], b[1], a[2], b[2]) for a in live for b in live if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and b[2] < (a[3] or far))
    plan = dimensions.overlapping_pairs(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Exchange")
    for places in (1, 3, 4, 1024):
        monkeypatch.setattr(dimensions, "PLACES", places)
        pairs = dimensions.overlapping_pairs(spark.createDataFrame(rows, schema))
        assert pairs.columns == ["product_id", "earlier", "later", "earlier_from", "later_from"]
        assert sorted(map(tuple, pairs.collect())) == want and len(want) > 200


def test_interval_join_by_places(spark):
    """Every version that holds is found, also where several do; events meet versions by place, not all of a product's."""
    rng = random.Random(9)
    rows, schema = _windows(spark, rng, 30)
    times = [datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(-100, 3200)) for _ in range(80)] + [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(0, 50, 3)] + [None]
    asked = [(i, rng.choice([1, 1, 2, 3, None]), t) for i, t in enumerate(times)]
    far = datetime(9999, 1, 1)
    holds = lambda e, r: None not in (e[1], e[2], r[2]) and e[1] == r[0] and r[2] <= e[2] < (r[3] or far)
    want = []
    for e in asked:
        found = [r for r in rows if holds(e, r)]
        want += [(*e, *r[1:]) for r in found] or [(*e, None, None, None)]
    events, history = spark.createDataFrame(asked, "i long, product_id long, event_time timestamp_ntz"), spark.createDataFrame(rows, schema)
    for more in ({}, {"slice_seconds": 3600}, {"slice_seconds": 7200, "hot": [1]}):
        got = joins.interval_join(events, history, "product_id", **more)
        assert got.columns == ["i", "product_id", "event_time", "product_version", "valid_from", "valid_to"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 150
    single = history.filter("product_version = 1")
    assert joins.interval_join(events, single.limit(0), "product_id").count() == len(asked)


def test_interval_join_compares_few(spark):
    """A product of 30,000 versions and events would be 900 million comparisons."""
    n = 30_000
    time = lambda seconds: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")
    history = spark.range(n).select(F.lit(1).cast("long").alias("product_id"), F.col("id").alias("version"), time("10 * id").alias("valid_from"), time("10 * id + 10").alias("valid_to"))
    events = spark.range(n).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("product_id"), time("10 * id + 3").alias("event_time"))
    joined = joins.interval_join(events, history, "product_id")
    keys = [x for x in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(keys) == 1 and keys[0].count(" = ") == 2
    assert joined.filter("version = i").count() == n == joined.count()
