import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tarnlake import functions as fn
from tarnlake.operators import cleaning, dimensions, facts, joins, sessions

T0 = datetime(2024, 1, 1)
EVENT = "event_id long, event_time timestamp_ntz, event_type string, product_id long, price double, user_id long, user_session string, brand string, category_code string"


def events(spark, rows):
    base = dict(event_id=0, event_time=T0, event_type="view", product_id=1, price=1.0, user_id=1, user_session="s", brand="b", category_code="a.b")
    names = list(base)
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], EVENT)


def test_event_key_vector(spark):
    row = dict(user_id=520088904, event_type="view", product_id=1003461, event_time=datetime(2019, 11, 1))
    key = events(spark, [row]).select(fn.event_key()).first()[0]
    assert key == "7cbfeb1526ace30523fdf55f20d4cbb347e864c507e06705c8a3be3c30df57d2"


@pytest.mark.parametrize(("code", "levels"), [(None, (None, None, None)), ("", ("", None, None)), ("a", ("a", None, None)), ("a.b", ("a", "b", None)), ("a.b.c.d", ("a", "b", "c"))])
def test_category_levels(spark, code, levels):
    r = cleaning.parse_category(events(spark, [dict(category_code=code)])).first()
    assert (r["category_l1"], r["category_l2"], r["category_l3"]) == levels


def test_business_rules(spark):
    rows = [dict(event_id=i, price=p) for i, p in enumerate([None, -0.01, 0.0, math.nan])] + [dict(event_id=9, user_session=None), dict(event_id=10, event_time=datetime(2018, 1, 1)), dict(event_id=11, event_time=None)]
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    e = events(spark, rows)
    assert {r["event_id"] for r in cleaning.apply_business_rules(e, now).collect()} == {2, 3}
    assert cleaning.drop_counts(e, now).first().asDict() == {"rows_in": 7, "dropped_session": 1, "dropped_price": 2, "dropped_time": 2, "rows_out": 2}


def test_watermark_is_inclusive(spark):
    e = events(spark, [dict(event_id=1, event_time=T0 - timedelta(days=3)), dict(event_id=2, event_time=T0 - timedelta(days=3, microseconds=1))])
    assert [r["event_id"] for r in cleaning.since_watermark(e, T0).collect()] == [1]
    assert cleaning.since_watermark(e, None).count() == 2


@pytest.mark.parametrize(("gap", "n"), [(timedelta(seconds=1800), 1), (timedelta(seconds=1800, microseconds=1), 2)])
def test_session_gap(spark, gap, n):
    e = cleaning.with_event_key(events(spark, [dict(event_id=1), dict(event_id=2, event_time=T0 + gap)]))
    assert sessions.sessionize(e).select("session_id").distinct().count() == n


def test_history_and_asof(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [
        dict(event_id=1, event_time=at(0), price=1.0, brand="x"), dict(event_id=2, event_time=at(1), price=1.0, brand=None),
        dict(event_id=3, event_time=at(2), price=2.0), dict(event_id=4, event_time=at(3), price=2.0, category_code=None),
        dict(event_id=5, event_time=at(4), price=None, category_code=""), dict(event_id=6, product_id=None),
    ]
    e = cleaning.with_event_key(cleaning.parse_category(events(spark, rows)))
    h = dimensions.product_history(e).orderBy("valid_from").collect()
    assert [(r["product_version"], r["valid_from"], r["valid_to"], r["is_current"]) for r in h] == [(1, at(0), at(2), False), (2, at(2), at(3), False), (3, at(3), None, True)]
    assert h[0]["brand"] == "x" and h[2]["price"] == 2.0
    history = dimensions.product_history(e)
    asked = spark.createDataFrame([(0, 1, at(0)), (1, 1, at(2)), (2, 1, at(1.5)), (3, 1, at(99)), (4, 1, at(-1)), (5, 2, at(1)), (6, None, at(1))], "i int, product_id long, event_time timestamp_ntz")
    for salts in (1, 3):
        got = {r["i"]: r["product_version"] for r in joins.asof_join(asked, history, "product_id", carry=["product_version"], salts=salts).collect()}
        assert got == {0: 1, 1: 2, 2: 1, 3: 3, 4: None, 5: None, 6: None}
    assert dimensions.overlapping_versions(history).count() == 0


def test_versions_of_one_instant_become_one(spark):
    e = cleaning.with_event_key(cleaning.parse_category(events(spark, [dict(event_id=i, price=float(i), user_id=i) for i in range(4)])))
    h = dimensions.product_history(e).collect()
    assert len(h) == 1 and h[0]["is_current"]


def test_growth_labels(spark):
    rows = [("a", datetime(2024, m, 2), v) for m, v in ((1, 0.0), (2, 10.0), (4, 15.0))]
    p = spark.createDataFrame([(str(i), 1, t, v) for i, (_, t, v) in enumerate(rows)], "purchase_key string, product_key int, purchased_at timestamp_ntz, revenue double")
    cat = spark.createDataFrame([(1, "a")], "product_key int, category_l1 string")
    got = facts.category_performance(p, cat).orderBy("period").collect()
    assert [(r["growth_rate_label"], r["revenue_growth_rate"]) for r in got] == [("new_category", None), ("no_prior_revenue", None), ("comparable", 0.5)]


def test_date_dimension(spark):
    d = dimensions.date_dimension(spark)
    assert d.count() == 3287
    r = d.filter("date_day = DATE '2024-02-04'").first()
    assert (r["date_key"], r["day_of_week"], r["day_name"], r["is_weekend"]) == (20240204, 0, "Sunday", True)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 20000)), min_size=1, max_size=40))
def test_sessions_match_a_plain_walk(spark, rows):
    e = cleaning.with_event_key(events(spark, [dict(event_id=i, user_id=u, event_time=T0 + timedelta(seconds=s), product_id=i) for i, (u, s) in enumerate(rows)]))
    want = {}
    for u in {u for u, _ in rows}:
        times = sorted(s for v, s in rows if v == u)
        want[u] = 1 + sum(b - a > 1800 for a, b in zip(times, times[1:], strict=False))
    for slices in (None, 3600):
        got = sessions.sessionize(e, slice_seconds=slices).groupBy("user_id").agg(F.max("user_session_seq")).collect()
        assert {r[0]: r[1] for r in got} == want
