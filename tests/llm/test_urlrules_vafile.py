import random

import numpy as np
import pytest
from tarnlake.llm import urlrules, vafile


def slow_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(p), p, a) for a, p in rules if (host == (h := p.partition("/")[0]) or host.endswith("." + h)) and path.startswith("".join(p.partition("/")[1:]))]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "a.example.com", "net", "b.net", "x.b.net", "org", "examplé.com", "com.example", ""]
    rules = list({p: (rng.choice(["allow", "block"]), p) for p in (rng.choice(hosts[:8]) + "/" + rng.choice(["", "en/", "en/7", "de"]) for _ in range(12))}.values())
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'WWW.', 'evil'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/7', '/en/8?x=/en', '#/en/', '?q', '/de', '/e\nn'])}" for _ in range(300)] + [None, "", "no-scheme.com/en/", "://", "a://b://c"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = sorted(urlrules.judge(pages, urlrules.rule_table(spark, rules)).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [slow_judge(u, rules) for u in urls]


def test_a_hot_host_with_many_paths(spark, monkeypatch):
    rng = random.Random(3)
    rules = list({(p := f"big.com/{rng.randrange(300)}{rng.choice(['', '/', '/a', '/ab'])}"): ("block" if rng.random() < 0.5 else "allow", p) for _ in range(600)}.values()) + [("block", "com"), ("allow", "x.big.com/1")]
    urls = [f"http://{rng.choice(['', '', 'x.', 'y.x.'])}big.com/{rng.randrange(400)}{rng.choice(['', '/', '/a', '/abc', '/é'])}" for _ in range(800)] + ["http://other.org/1"] * 3
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, space int, _r int")
    want = [slow_judge(u, rules) for u in urls]
    for most in (10**5, 0):
        monkeypatch.setattr(urlrules, "MOST_SENT", most)
        got = urlrules.judge(pages, urlrules.rule_table(spark, rules))
        assert got.columns == ["page_id", "url", "space", "_r", "host", "path", "rule", "verdict"]
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == want
    paths = spark.createDataFrame([("k", p) for p in {"".join("".join(r[1].partition("/")[1:])) for r in rules}], "space string, key string")
    assert urlrules.stacks(paths, urlrules.F.sequence(urlrules.F.lit(0), urlrules.F.length("key"))).selectExpr("max(size(stack))").first()[0] < 12


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(pages, urlrules.rule_table(spark, [("block", "com/")])).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, rule string, host string, path string")
    assert urlrules.judge(one, none).first()["verdict"] == "allow"


def brute(rows, asked, k=10):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in {(i, tuple(v)) for i, v in good if asked(i)}:
        best = sorted((-int(np.array(v, int) @ w), j) for j, w in good if j != q and len(w) == len(v))[:k]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(want)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, [1.0, 2.0]), (1005, [3.0, 1.0]), (None, [1.0] * 8), (7, rows[7][1]), (50, rows[3][1]), (1006, []), (1050, []), (1007, [])]
    rows += [(2000 + i, [1e4 * float(x) for x in rng.normal(size=3)]) for i in range(40)] + [(2100, [0.0] * 5)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    asked = table.filter("vec_id % 50 = 0 OR vec_id IN (7, 1001, 1004)")
    want = brute(rows, lambda i: i % 50 == 0 or i in (7, 1004))
    for k, batch in ((10, 4096), (10, 5)):
        assert sorted(tuple(r) for r in vafile.top_k(table, asked, k, batch=batch).collect()) == want
    assert sorted(tuple(r) for r in vafile.top_k(table, asked, 2).collect()) == brute(rows, lambda i: i % 50 == 0 or i in (7, 1004), 2)


def test_bounds_hold_and_few_vectors_are_read():
    rng = np.random.default_rng(6)
    values = np.floor(1024 * rng.normal(size=(3000, 32)) / 5).astype(np.int64)
    grid = vafile.Grid(values.min(axis=0), values.max(axis=0))
    lower, more = grid.bounds(grid.cells(values), values[:20])
    exact = values[:20] @ values.T
    assert (lower <= exact).all() and (exact <= lower + more[:, None]).all()
    best = vafile._Best(np.arange(20), 10)
    for at in range(0, 3000, 500):
        best.add(0, np.arange(at, at + 500), lower[:, at : at + 500], more)
    for q in range(20):
        best.prune(q, more[q])
        kept = set(best.rows[q][0][0].tolist())
        top = sorted((-s, j) for j, s in enumerate(exact[q].tolist()) if j != q)[:10]
        assert {j for _, j in top} <= kept and len(kept) < 100  # of 3000


def test_hot_vector_is_cut(spark):
    rows = spark.createDataFrame([(i, [1, 2]) for i in range(500)] + [(1000, [3, 4])] * 3, "vec_id long, v array<long>")
    got = sorted(r["vec_id"] for r in vafile._without_copies(rows, 4).collect())
    assert got == [0, 1, 2, 3, 4, 1000, 1000, 1000]


def test_repeated_rows_of_one_id_hide_no_other(spark):
    rows = [(0, [1.0, 2.0])] * 12 + [(1, [1.0, 2.0]), (2, [0.5, 0.5])] + [(3, [1.0, 2.0])] * 30
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2, 4):
        assert sorted(tuple(r) for r in vafile.top_k(table, table.filter("vec_id IN (0, 3)"), k).collect()) == brute(rows, lambda i: i in (0, 3), k)


def test_scores_beyond_64_bits(spark):
    table = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1.0, 1e8])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        vafile.top_k(table, table)


def test_top_k_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(table, table).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vafile.top_k(one, one).collect() == []
