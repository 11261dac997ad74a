"""Benchmark decontamination by winnowing.

Of each text's k-gram hashes the minimum of every sliding window is kept. Two texts that share
``span`` words share a kept k-gram there (k = (span + 1) // 2, windows of span + 1 - k), so joining the
fingerprints of documents and items finds each shared span. A hit is extended to both sides over the
windows of ``span`` words that hold it, each looked up among the items' distinct windows and compared
by its bytes, so equal hashes alone prove nothing.

A window that many items share is there once, with the set of its items; windows with the same items
share a set. What a text costs follows from its own words, not from how many items have a passage.

The items' fingerprints go to the workers in blocks of bounded size. With several blocks each reads the
texts anew and hands on only its hits, by 128 bits of the text, so no text is copied between passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checkpoints
from . import words as W

SPAN = 13
#: Bytes of item text in a block: what a pass broadcasts stays below about twelve times this.
BLOCK_BYTES = 8 << 20
#: Texts with hits that a join may broadcast.
MOST_SENT = 100_000
#: Item ids that leave a worker in one batch.
MOST_IDS = 1 << 20
SPANS = "array<struct<start:long,end:long>>"


def winnow(grams: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """Places of the k-grams that are the minimum of a window of ``window`` of them. ok: k-grams within one text; a window stays within one."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, whole = grams[:n].copy(), ok[:n].copy()
    for j in range(1, window):
        np.minimum(low, grams[j : j + n], out=low)
        whole &= ok[j : j + n]
    low[~whole] = 0
    best = np.zeros(len(grams), np.uint64)
    for j in range(window):
        np.maximum(best[j : j + n], low, out=best[j : j + n])
    return np.flatnonzero((best == grams) & (best > 0))


class Windows:
    """Distinct windows of ``size`` words: sorted keys, the first word of a specimen, and the place of each one's set of items."""

    def __init__(self, found: W.Words, size: int, at: np.ndarray, key: np.ndarray, owner: np.ndarray, sets: _Sets):
        """at: first words of all windows, with their hashes and items."""
        self.size = size
        order = np.lexsort((owner, key))
        at, key, owner = at[order], key[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        like = np.repeat(at[first], np.diff(np.append(first, len(key))))
        odd = ~_equal(found, at, found, like, size)  # another text of the same hash
        if odd.any():
            texts = np.array([b" ".join(found.text(i + j).lower() for j in range(size)) for i in at[odd].tolist()])
            kind = np.zeros(len(at), np.int64)
            kind[odd] = 1 + np.unique(texts, return_inverse=True)[1]
            order = np.lexsort((owner, kind, key))
            at, key, owner, kind = at[order], key[order], owner[order], kind[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
        self.key, self.at = key[first], at[first]
        ends = np.append(first[1:], len(key))[: len(first)]
        self.set = np.array([sets.add(owner[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], np.int64)


class _Sets:
    """Distinct sets of items, each once."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []

    def add(self, owners: np.ndarray) -> int:
        own = np.unique(owners) if len(owners) > 1 else owners
        key = own.tobytes()
        if key not in self.known:
            self.known[key] = len(self.items)
            self.items.append(own.copy())
        return self.known[key]


def _equal(a: W.Words, i: np.ndarray, b: W.Words, j: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from i are those from j, byte for byte after folding."""
    out = np.ones(len(i), bool)
    mine, theirs = (W.ALNUM.fold[x.data] for x in (a, b))
    for k in range(size):
        live = np.flatnonzero(out)
        p, q = i[live] + k, j[live] + k
        out[live] = W.same(mine, a.start[p], a.end[p], theirs, b.start[q], b.end[q])
    return out


class Items:
    """Fingerprints and windows of some items."""

    def __init__(self, rows: list[tuple[int, str | None]], span: int):
        self.span, self.k = span, (span + 1) // 2
        self.window = span + 1 - self.k
        self.found = found = W.split(pa.array([t for _, t in rows], pa.string()), W.ALNUM)
        ids = np.array([i for i, _ in rows], np.int64)
        n, sets = found.counts(), _Sets()
        owner = np.repeat(np.arange(len(rows)), n)
        grams = W.grams(found.hash, self.k)
        at = winnow(grams, W.fits(found.bounds, len(grams), self.k), self.window)
        self.key = np.unique(grams[at[n[owner[at]] >= span]])
        self.windows = []
        grams = W.grams(found.hash, span)
        at = np.flatnonzero(W.fits(found.bounds, len(grams), span))
        self.windows.append(Windows(found, span, at, grams[at], owner[at], sets))
        for size in sorted(set(n[(n > 0) & (n < span)].tolist())):  # such an item is one window
            own = np.flatnonzero(n == size)
            at = found.bounds[own]
            self.windows.append(Windows(found, size, at, W.grams(found.hash, size)[at], own, sets))
        self.sets = [np.unique(ids[x]) for x in sets.items]


def _meet(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in asked, place in the sorted keys) of equal values."""
    if not len(keys) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.searchsorted(keys, asked)
    hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == asked)
    low = low[hit]
    n = np.searchsorted(keys, asked[hit], "right") - low
    return np.repeat(hit, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def occurrences(found: W.Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur: first word, word beyond the last (among all words of the batch), place of the set of items; at most one for each place and size."""
    starts, ends, sets = [], [], []
    for windows in items.windows:
        size = windows.size
        grams = W.grams(found.hash, size)
        fit = W.fits(found.bounds, len(grams), size)
        if size == items.span:
            kept = W.grams(found.hash, items.k)
            at = winnow(kept, W.fits(found.bounds, len(kept), items.k), items.window)
            hit = at[_meet(items.key, kept[at])[0]]
            at = np.unique((hit[:, None] - np.arange(items.window)).ravel())  # the windows that hold the fingerprint
            at = at[(at >= 0) & (at < len(grams))]
            at = at[fit[at]]
        else:
            at = np.flatnonzero(fit)
        mine, theirs = _meet(windows.key, grams[at])
        at = at[mine]
        ok = _equal(found, at, items.found, windows.at[theirs], size)
        starts.append(at[ok])
        ends.append(at[ok] + size)
        sets.append(windows.set[theirs[ok]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(sets)


def _union(items: Items, sets: tuple[int, ...], known: dict) -> np.ndarray:
    if sets not in known:
        known[sets] = items.sets[sets[0]] if len(sets) == 1 else np.unique(np.concatenate([items.sets[s] for s in sets]))
    return known[sets]


def _judge(column: pa.Array, items: Items):
    """n_words, n_hit, spans and items of some texts, in parts (first text, beyond the last, four arrays) of a bounded number of ids."""
    found = W.split(column, W.ALNUM)
    n, counts = len(column), found.counts()
    start, end, which = occurrences(found, items)
    total = int(found.bounds[-1])
    edge = np.bincount(start, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    cover = np.zeros(total + 2, bool)
    cover[1:-1] = np.cumsum(edge)[:total] > 0
    hits = np.diff(np.concatenate([[0], np.cumsum(cover[1:-1])])[found.bounds])
    flag = np.zeros(total + 1, bool)
    flag[found.bounds[1:-1]] = True
    first = np.flatnonzero(cover[1:-1] & (~cover[:-2] | flag[:-1])) if total else np.zeros(0, np.int64)
    last = np.flatnonzero(cover[1:-1] & (~cover[2:] | flag[1:])) + 1 if total else first
    owner = np.searchsorted(found.bounds, first, "right") - 1
    spans = np.searchsorted(owner, np.arange(n + 1))
    first, last = first - found.bounds[owner], last - found.bounds[owner]
    text = np.searchsorted(found.bounds, start, "right") - 1
    pairs = np.unique(np.stack([text, which], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
    cuts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    at, known = 0, {}
    while at < n:
        ids, to, held = [], at, 0
        while to < n and held < MOST_IDS:
            own = pairs[cuts[to] : cuts[to + 1], 1]
            ids.append(_union(items, tuple(own.tolist()), known) if len(own) else own)
            held += len(ids[-1])
            to += 1
        if len(known) > 1000:
            known.clear()
        a, b = spans[at], spans[to]
        ranges = pa.StructArray.from_arrays([pa.array(first[a:b]), pa.array(last[a:b])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32()), pa.array(np.concatenate(ids), pa.int64()))
        yield at, to, [pa.array(counts[at:to]), pa.array(hits[at:to]), pa.ListArray.from_arrays(pa.array(spans[at : to + 1] - a, pa.int32()), ranges), lists]
        at = to


def _key() -> list[Column]:
    """128 bits of the text: what is found follows from the text alone."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(SPAN), text).alias("_k2")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES, most_sent: int = MOST_SENT) -> DataFrame:
    """docs (text and any other columns) with n_words, n_hit, spans and items.

    A document word is hit if it lies in an occurrence of ``span`` consecutive words of an item (of
    the whole item where that is shorter). spans are the hit ranges of words, items the sorted ids
    of items with an occurrence. Null and empty texts have no words; items with a null id are left
    out; repeated rows are judged each. Columns of docs that bear a name of the result are replaced.
    A worker's arrays are a small multiple of the longest text.
    """
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = ["n_words", "n_hit", "spans", "items"]
    empty = {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<long>")}
    base = docs.drop(*names).withColumns(empty)

    def one_pass(block, hits_only: bool):
        def judge(batches):
            own = block.value
            for batch in batches:
                for part in W.slices(batch, "text"):
                    column = dict(zip(part.schema.names, part.columns, strict=True))
                    for at, to, made in _judge(column["text"], own):
                        piece = {k: v.slice(at, to - at) for k, v in column.items()} | dict(zip(names, made, strict=True))
                        out = pa.RecordBatch.from_arrays([v.cast(kinds[k]) if k in kinds else v for k, v in piece.items()], list(piece))
                        yield out.filter(pc.greater(out.column(out.schema.get_field_index("n_hit")), 0)).drop_columns(["text"]) if hits_only else out

        return judge

    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.int64())}
    sent = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        sent.append(spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], span)))
    out = base.mapInArrow(one_pass(sent[0], False), base.schema)
    if blocks == 1:
        return out
    texts = docs.select(*_key(), F.col("text").cast("string").alias("text")).withColumns(empty)
    found = None
    for block in sent[1:]:
        hits = texts.mapInArrow(one_pass(block, True), texts.drop("text").schema).select("_k1", "_k2", "spans", "items").dropDuplicates(["_k1", "_k2"])
        found = hits if found is None else found.unionByName(hits)
    more = found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")).checkpoint()  # a row for each block at most
    keyed = out.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(out.columns)], *_key())
    met = keyed.join(F.broadcast(more) if more.count() <= most_sent else more, ["_k1", "_k2"], "left")
    place = {c: F.col(f"d{i}") for i, c in enumerate(out.columns)}
    ranges = F.array_sort(F.concat(place["spans"], F.coalesce("_spans", F.array().cast(SPANS))))
    joined = F.aggregate(ranges, F.array().cast(SPANS), _add)
    spans = F.when(F.col("_spans").isNull(), place["spans"]).otherwise(joined)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    all_items = F.array_sort(F.array_distinct(F.concat(place["items"], F.coalesce("_items", F.array().cast("array<long>")))))
    fresh = {"n_hit": hit, "spans": spans, "items": all_items}
    return met.select(*[fresh.get(c, place[c]).alias(c) for c in out.columns])


def _add(done: Column, s: Column) -> Column:
    """Sorted ranges become disjoint: ``s`` joins the last one where they touch."""
    last = F.element_at(done, -1)
    joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
    touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"])
    return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))
