"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint's bytes, with their positions, are its terms. Fingerprints that differ in at most r
bits share at least w - r of the w bytes at any w positions, so they share a posting list whose key is
some w - r of the first w positional bytes. Lists are streamed in key order; for each pair in a list
the shared positional bytes of the whole fingerprint are tallied, pairs below the guaranteed minimum
drop out, and the rest is verified by differing bits. Within a list only a spanning forest of the
verified links is passed on, so a large group of near copies never becomes all of its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checkpoints
from .components import connected_components

BYTES = 8
#: Fingerprints of one list that are compared at once; longer lists are dealt as pairs of such parts.
PART = 4096


def _fold(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() folds A-Z alone


def fingerprint(text: str | None, shingle: int = 3) -> int:
    parts = _fold((text or "").encode()).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = (starts + sizes)[shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]
    bits = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(values[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) to (doc_id, bits long): the fingerprint as a signed number. No words: zero."""

    def make(batches):
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, bits long")


def _width(n: int) -> int:
    """Positions to index for n fingerprints: chance neighbours in a list stay few."""
    return 6 if n < 1 << 22 else 7 if n < 1 << 30 else 8


def _close(x: np.ndarray, y: np.ndarray, radius: int, wanted: int) -> np.ndarray:
    """Which pairs reach the tally of shared positional bytes and then pass the verification."""
    diff = x ^ y
    shared = (diff.view(np.uint8).reshape(*diff.shape, BYTES) == 0).sum(axis=-1)
    out = shared >= wanted
    out[out] = np.bitwise_count(diff[out]) <= radius
    return out


def _forest(bits: np.ndarray, ids: np.ndarray, radius: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows. left: only links from the first ``left`` rows to the others."""
    n, wanted = len(bits), BYTES - radius
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n if left is None else left):
        others = np.arange(i + 1 if left is None else left, n)
        if not len(others):
            continue
        for j in others[_close(bits[others], np.full(len(others), bits[i], np.uint64), radius, wanted)].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def links(prints: DataFrame, radius: int = 3, part: int = PART, width: int | None = None) -> DataFrame:
    """prints (node long, bits long; stored, bits distinct) to edges (a, b) that connect exactly the components of the links. width: positions to index, by their number if None; any width above radius gives the same components."""
    if not 0 <= radius < BYTES:
        raise ValueError("the count filter needs a radius below the number of bytes")
    width = width or _width(prints.count())
    keys = [sum(0xFF << 8 * (BYTES - 1 - p) for p in places) for places in combinations(range(width), max(1, width - radius))] if width > radius else [0]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    entry = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.col("bits").bitwiseAND(F.lit(k).cast("long")).alias("key")) for i, k in enumerate(signed)])).alias("e")
    posts = prints.select("node", "bits", entry).select("e.place", "e.key", "node", "bits")
    sizes = posts.groupBy("place", "key").agg(F.count("*").alias("n"))
    long_lists = sizes.filter(F.col("n") > part).withColumn("parts", F.ceil(F.col("n") / part).cast("long")).checkpoint()
    short = posts
    if not long_lists.isEmpty():
        short = posts.join(long_lists, ["place", "key"], "left_anti")
    schema = "a long, b long"

    def scan(batches):
        """Rows come in key order; a list may go on in the next batch."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            place, key = (table.column(c).to_numpy() for c in ("place", "key"))
            new = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            yield from _lists(table.slice(0, last), new[:-1] if len(new) else new)
            rest = table.slice(last)
            held = rest.to_batches()[0] if rest.num_rows else None
        if held is not None:
            yield from _lists(pa.Table.from_batches([held]), np.zeros(0, np.int64))

    def _lists(table, cuts):
        if table.num_rows < 2:
            return
        bits = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        ids = table.column("node").to_numpy()
        edges = np.concatenate([[0], cuts, [table.num_rows]])
        sizes = np.diff(edges)
        pairs = edges[:-1][sizes == 2]  # most lists of more than one entry are pairs
        out = []
        if len(pairs):
            ok = _close(bits[pairs], bits[pairs + 1], radius, BYTES - radius)
            out += zip(ids[pairs[ok]].tolist(), ids[pairs[ok] + 1].tolist(), strict=True)
        for i in np.flatnonzero(sizes > 2).tolist():
            at = slice(edges[i], edges[i + 1])
            out += _forest(bits[at], ids[at], radius)
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = short.repartition("place", "key").sortWithinPartitions("place", "key").mapInArrow(scan, schema)
    if long_lists.isEmpty():
        return found

    def across(keys_, table):
        table = table.sort_by([("side", "ascending")])
        bits, ids = table.column("bits").to_numpy().astype(np.int64).view(np.uint64), table.column("node").to_numpy()
        same = keys_[2].as_py() == keys_[3].as_py()
        out = _forest(bits, ids, radius, None if same else int(pc.sum(pc.equal(table.column("side"), 0)).as_py() or 0))
        return pa.table({c: pa.array([e[i] for e in out], pa.int64()) for i, c in enumerate("ab")})

    dealt = posts.join(F.broadcast(long_lists.drop("n")) if long_lists.count() < 10_000 else long_lists.drop("n"), ["place", "key"]).withColumn("own", F.pmod(F.xxhash64("bits"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    sides = dealt.select("*", other).select("place", "key", "node", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return found.unionByName(sides.groupBy("place", "key", "p", "q").applyInArrow(across, schema))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs (doc_id, text) to (doc_id, bits, component_id), one row for each row with an id.

    Words are runs without ASCII white space, A-Z lower-cased; shingles count as often as they
    occur; a text of fewer words is one shingle, a text without words has fingerprint zero and links
    like any other. component_id is the smallest doc_id reachable over links of at most ``radius``
    bits. Rows without an id take no part; repeated rows stay, other columns are ignored.
    """
    checkpoints.ensure(docs.sparkSession)
    own = fingerprints(docs.filter("doc_id IS NOT NULL"), shingle).checkpoint()
    distinct = own.groupBy("bits").agg(F.min("doc_id").alias("node")).checkpoint()
    roots = connected_components(links(distinct, radius))
    named = distinct.join(roots, "node", "left").select("bits", F.coalesce("root", "node").alias("component_id"))
    return own.join(named, "bits").select("doc_id", "bits", "component_id")
