import random

import corpus_pipeline as cp
import pyarrow as pa
from tarnlake.llm import jaccard, simhash


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def texts():
    rng = random.Random(3)
    out = ["", None, "one", "One", "two words", "a b c d", "a b c d e", "ÜNÏ çode x y z w"]
    for _ in range(40):
        words = [f"W{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append("\n".join(copy).lower())
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))
    between = 0
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            union = len(x | y)
            between += bool(union) and 80 <= 100 * len(x & y) / union < 95
            if x == y or 100 * len(x & y) >= 80 * union:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert between > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (10**6, 0):
        found = jaccard.near_duplicates(docs, most_sent=most).collect()
        least = {}
        for r in found:
            least[r["group"]] = min(least.get(r["group"], 10**9), r["doc_id"])
        assert {r["doc_id"]: least[r["group"]] for r in found} == {i: root[i] for i, _ in rows}
        kept = jaccard.representatives(docs.withColumn("group", docs["doc_id"]), most_sent=most)
        assert kept.columns == ["doc_id", "text", "group"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_rows_of_one_id(spark):
    """Other texts of an id are other documents; only copies go, whatever id they bear."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "alpha beta gamma", "x"), (1, long, "x"), (2, long + " end", "x"), (3, "its own text entirely", "x"), (3, "its own text entirely", "y"), (None, long, "x"), (None, "another text of none", "x"), (2, "kept beside it", "x"), (9, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    for most in (10**6, 0):
        kept = sorted(map(tuple, jaccard.representatives(docs, most_sent=most).collect()), key=str)
        assert kept == sorted([rows[0], rows[1], rows[3], rows[6], rows[7], rows[9]], key=str)


def test_a_large_group_is_not_all_of_its_pairs(spark):
    """Near copies of one text, chains from copy to copy, and texts just beyond them."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"c{rng.randrange(10**6)}"
        return out

    own = [base] + [changed(base, rng.randrange(1, 4)) for _ in range(120)]
    own += [changed(own[rng.randrange(1, len(own))], 2) for _ in range(40)] + [changed(base, 6) for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (jaccard.BLOCK, 8000):
        least = {}
        found = jaccard.near_duplicates(docs, block=block).collect()
        for r in found:
            least[r["group"]] = min(least.get(r["group"], 10**9), r["doc_id"])
        assert {r["doc_id"]: least[r["group"]] for r in found} == dict(enumerate(root))


def test_blocks_return_forests():
    """Sets that share and don't, in more columns than one product takes; links within a label are left out."""
    own = [set(range(k, k + 50)) for k in (0, 2, 4, 6, 100, 102)]
    table = lambda side, at, label: pa.table({f"{side}_own": pa.array([bytes([i]) for i in at], pa.binary()), f"{side}_label": pa.array([label(i) for i in at], pa.binary()), f"{side}_hashes": pa.array([sorted(own[i]) for i in at], pa.list_(pa.int64()))})
    x, y = table("x", [0, 4], lambda i: bytes([i])), table("y", range(6), lambda i: bytes([i]))
    for width in (4096, 7):
        both, n, m = jaccard._shared(x["x_hashes"], y["y_hashes"], width)
        assert both.tolist() == [[len(own[i] & own[j]) for j in range(6)] for i in (0, 4)] and list(n) == [50, 50] and list(m) == [50] * 6
    assert set(zip(*jaccard._forest(x, y, 80), strict=True)) == {(b"\0", bytes([i])) for i in (1, 2)} | {(b"\4", b"\5")}
    assert jaccard._forest(*[table(side, range(6), lambda i: b"s") for side in "xy"], 80) == ([], [])


def test_sets():
    value, bounds = jaccard.shingles(pa.array(["a b c d e f a b c d e", "", "A b", "x", None, "a B"]), 5)
    assert [int(b - a) for a, b in zip(bounds, bounds[1:], strict=False)] == [6, 0, 1, 1, 0, 1]
    assert value[bounds[2]] == value[bounds[5]] != value[bounds[3]]


def test_stage_removes_copies_beyond_three_bits(spark):
    rng = random.Random(4)
    pairs = []
    while len(pairs) < 5:
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(words)
        for at in range(20, 300, 60):
            copy[at] = f"n{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(copy)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3:
            pairs.append((a, b))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6, 8]


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
