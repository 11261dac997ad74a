import random
import re

import xxhash
from tarnlake.llm import queries, simhash
from tarnlake.llm.components import connected_components


def slow_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=3):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(5)
    out = ["", "  \t", "One", "one", "two words", "Ünï Çode", "ÜNÏ çode x"]
    for _ in range(40):
        words = [rng.choice("alpha Beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 300))]
        out.append("  ".join(words))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\n".join(copy))
    return [*out, out[20], None]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bits string, node int")
    got = {r["doc_id"]: (r["bits"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == slow_components(prints)


def test_long_lists_are_dealt_in_parts(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    prints = {i: base ^ (1 << rng.randrange(24) | 1 << rng.randrange(24) | 1 << rng.randrange(24) | 1 << rng.randrange(24)) for i in range(200)}
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for p, i in first.items()]
    table = spark.createDataFrame(rows, "node long, bits long").checkpoint()
    want = slow_components({i: p for p, i in first.items()})
    for part in (16, 4096):
        edges = simhash.links(table, part=part)
        got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0}
    assert {got[i] for i in range(100, 140)} == {100}
    assert got[200] == got[201] == 200


def test_empty_and_null_ids(spark):
    kind = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, "a b c d"), (3, None), (5, ""), (3, None)]
    got = sorted((r["doc_id"], r["bits"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, kind)).collect())
    assert got == [(3, 0, 3), (3, 0, 3), (5, 0, 3)]


def test_all_widths_give_the_same_components(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(3)})
    prints = [p & (1 << 64) - 1 for p in prints]
    want = slow_components(dict(enumerate(prints)))
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, bits long").checkpoint()
    for width in (6, 7, 8):
        roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(table, width=width)).collect()}
        assert {i: roots.get(i, i) for i in want} == want


def test_query_gives_hex_and_the_smallest_id(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op6_simhash_dedup(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    prints = [slow_print(t) for _, t in rows]
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints] and {r["doc_id"]: r["component_id"] for r in got} == slow_components(dict(enumerate(prints)))
