import random
import re

import numpy as np
import pyarrow as pa
from tarnlake.llm import decontam
from tarnlake.llm import words as W


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(texts, items, span=13):
    out = []
    for text in texts:
        own = words(text)
        hit, which = set(), set()
        for i, item in items:
            w = words(item)
            n = min(span, len(w))
            windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            for j in range(len(own) - n + 1):
                if tuple(own[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    which.add(i)
        out.append((len(own), len(hit), sorted(which)))
    return out


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "A", "é", "x1", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(99, None), (50, "..."), (51, "rare short item")]
    texts = [None, "", "!!", "a rare, SHORT item here", "rare short", "rare short item"]
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            own[5:5] = w[a : a + rng.randrange(1, 30)]
        texts.append("-".join(own))
    return texts, items


def test_matches_brute_force(spark):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*items, (None, "no id")], "item_id long, text string")
    want = slow(texts, items)
    for block, sent in ((8 << 20, 1), (600, 1), (600, 1000)):
        rows = sorted(decontam.decontaminate(docs, bench, block_bytes=block, most_sent=sent).collect(), key=lambda r: r["doc_id"])
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in rows)


def judged(texts, items, span=13):
    out = []
    for _, _, made in decontam._judge(pa.array(texts, pa.string()), decontam.Items(items, span)):
        out += zip(made[0].to_pylist(), made[1].to_pylist(), made[3].to_pylist(), strict=True)
    return out


def test_equal_hashes_prove_nothing(monkeypatch):
    texts, items = cases()
    items = [(i, t) for i, t in items if t is not None]
    want = slow(texts, items)
    real = W.hashed
    monkeypatch.setattr(W, "hashed", lambda *a: real(*a) % np.uint64(2))
    monkeypatch.setattr(decontam, "MOST_IDS", 5)
    assert judged(texts, items) == want


def test_patterned_words_differ():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    found = W.split(pa.array([a, b]), W.ALNUM)
    assert found.hash[0] != found.hash[1]
    line = "one two three four five six seven eight nine ten eleven twelve "
    assert [r[1] for r in judged([line + a, line + b], [(1, line + a)])] == [13, 0]


def test_a_passage_of_many_items():
    stem = " ".join(f"s{i}" for i in range(20))
    items = [(i, f"{stem} own{i} a b c d e f g h") for i in range(2000)]
    found = decontam.Items(items, 13)
    texts = [" x ".join([stem] * 1000), stem, None, "yes " * 1000]
    start, _, which = decontam.occurrences(W.split(pa.array(texts), W.ALNUM), found)
    assert len(start) == 8 * 1001 and len(set(which.tolist())) == 1  # not a row for each item
    got = judged(texts, [*items, (5000, "yes"), (5001, "YES")])
    assert got[0] == (20_000 + 999, 20_000, list(range(2000))) and got[1][2] == list(range(2000)) and got[3] == (1000, 1000, [5000, 5001])


def test_long_text():
    rng = random.Random(4)
    item = " ".join(str(rng.randrange(10**6)) for _ in range(30))
    text = " ".join(str(rng.randrange(10**6)) for _ in range(300_000))
    assert judged([text + " " + item + " " + text, "x" * 10**6], [(1, item)]) == [(600_030, 30, [1]), (1, 0, [])]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert decontam.decontaminate(one, bench).first()["n_hit"] == 0
