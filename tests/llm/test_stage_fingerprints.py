"""The pipeline's near-duplicate stage meets sets through SimHash fingerprints too."""

import random

import numpy as np
import pyarrow as pa
from tarnlake.llm import jaccard


def slow_fingerprint(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_count_bits(monkeypatch):
    rng = random.Random(1)
    column = pa.array([None, "", "one", *[" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (3, 40, 200)], ""])
    value, bounds = jaccard.shingles(column, 5)
    want = [slow_fingerprint(value[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    for most in (1 << 16, 7):
        monkeypatch.setattr(jaccard, "COUNTED", most)
        assert jaccard._fingerprints(value, bounds).view(np.uint64).tolist() == want


def test_sets_within_three_bits_meet(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(20)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints for k in (1, 3, 3, 4, 6)]
    prints += prints[:5]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = jaccard.by_fingerprint(spark.createDataFrame([(bytes([i]), 9, p) for i, p in enumerate(signed)], "own binary, n long, bits long")).collect()
    root = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    key = {r["own"][0]: r["key"] for r in found}
    assert len(found) == len(prints) and {r["band"] for r in found} == {jaccard.BANDS}
    assert all((key[i] == key[j]) == (root[i] == root[j]) for i in range(len(prints)) for j in range(i))


def test_links_without_a_common_minimum_are_found(spark):
    """Of 60,000 such pairs of texts at 0.8, 25 keys of five minima each lost these four, and their fingerprints differ in 8 bits or more."""
    rows = []
    for i in (4129, 13504, 30912, 36585):
        words = [f"w{i}x{k}" for k in range(14)]
        rows += [(2 * i, " ".join(words[:13])), (2 * i + 1, " ".join(words[1:])), (10**6 + i, " ".join(words[3:9] + words[:3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in jaccard.near_duplicates(docs).collect():
        groups.setdefault(r["group"], []).append(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == sorted(x for i in (4129, 13504, 30912, 36585) for x in ([2 * i, 2 * i + 1], [10**6 + i]))


def test_fingerprints_of_stored_sets(spark):
    rng = random.Random(3)
    own = [[rng.getrandbits(63) for _ in range(n)] for n in (4, 30, 7)]
    sets = spark.createDataFrame([(bytes([i]), hashes) for i, hashes in enumerate(own)], "own binary, hashes array<long>").coalesce(1)
    found = {r["own"][0]: (r["n"], r["bits"] % 2**64) for r in jaccard._printed(sets).collect()}
    assert found == {i: (len(hashes), slow_fingerprint(hashes)) for i, hashes in enumerate(own)}
