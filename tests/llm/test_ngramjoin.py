"""The Jaccard join against plain Python over all pairs, and its signatures' guarantee."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import ngramjoin

_UPPER = {c: c + 32 for c in range(65, 91)}


def _set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _expected(rows, size=4, percent=85):
    sets = [_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in ngramjoin.jaccard_join(docs, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def _corpus(rng, groups=6, copies=12, words=80):
    rows, n = [], 0
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def test_chains_at_the_threshold_and_odd_rows(spark):
    rng = random.Random(3)
    rows = _corpus(rng)
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one TWO"), (505, "one two three"), (506, "a b c d"), (506, "a b c d e f g h"), (None, "a b c d"), (None, "lonely words without any company here"), rows[5], (507, "x " * 3000), (508, "X\t" * 2999)]
    assert _found(spark, rows) == _expected(rows)


def test_all_ways_give_the_same(spark):
    rows = _corpus(random.Random(5), groups=4, copies=10, words=50)
    want = _expected(rows)
    assert _found(spark, rows, screens=(1.0,), block=4000) == want
    assert _found(spark, rows, screens=(0.05, 0.3, 0.9), most_sent=0) == want
    assert _found(spark, rows, size=2, percent=60) == _expected(rows, 2, 60)


def test_empty_table_and_columns_of_other_names(spark):
    assert _found(spark, []) == []
    docs = spark.createDataFrame([(2, "a b c d e", 7, "x"), (1, "a b c d e", 8, "y")], "doc_id long, text string, own long, `key` string")
    assert sorted(r["component_id"] for r in ngramjoin.jaccard_join(docs).collect()) == [1, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(7, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_key(n, lost, gained, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 63, n + gained).astype(np.uint64))
    a, b = base[: len(base) - gained], base[min(lost, len(base) - 1) :]
    both = len(np.intersect1d(a, b))
    if 100 * both < 85 * (len(a) + len(b) - both):
        return
    counts = rng.choice([2, 3, 20, 5000], len(base))  # the shingles of both are held by two sets at least
    of = dict(zip(base.tolist(), counts.tolist(), strict=True))
    keys = []
    for s in (a, b):
        shared = np.array([x for x in s.tolist() if x in set(a.tolist()) & set(b.tolist()) or of[x] > 2], np.uint64)
        keys.append(ngramjoin.signatures(len(s), shared, np.array([of[x] for x in shared.tolist()]), 85))
    if len(a) == len(b) == both:
        return  # equal sets are one set
    assert len(np.intersect1d(*keys))


def test_keys_grow_with_the_set_alone():
    rng = np.random.default_rng(1)
    for n in (50, 500, 20_000):
        token = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for held in (3, 100, 10_000):
            assert len(ngramjoin.signatures(n, token, np.full(n, held), 85)) <= 12 * n
    assert len(ngramjoin.signatures(100, token[:80], np.full(80, 9), 85)) == 0  # a fifth is held by no other set


def test_small_sets_that_lack_nothing_of_their_partner(spark):
    """Six shingles of seven: 600 >= 85 * 7, though a set of six may lack none itself."""
    line = "a b c d e f g h i"
    rows = [(1, line + " j"), (2, line), (3, "z " + line), (4, "q r s t u v w x y"), (5, "q r s t u v w x"), (6, "q r s t u v w x"), (7, line.upper())]
    assert _found(spark, rows) == _expected(rows)
    assert {r[0]: r[2] for r in _found(spark, rows)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 1}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([30, 45, 60, 85, 95]), st.integers(1, 40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6))
def test_linked_small_sets_share_a_key_at_any_threshold(percent, both, lost, gained, seed):
    if 100 * both < percent * (both + lost + gained) or lost + gained == 0:
        return
    rng = np.random.default_rng(seed)
    base = rng.choice(1 << 62, both + lost + gained, replace=False).astype(np.uint64)
    held = rng.choice([2, 20, 5000], len(base))
    keys = [ngramjoin.signatures(int(at.sum()), base[at], held[at], percent) for at in (np.arange(len(base)) < both + lost, (np.arange(len(base)) < both) | (np.arange(len(base)) >= both + lost))]
    assert len(np.intersect1d(*keys))
