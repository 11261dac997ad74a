"""A quality classifier on an interpolated modified Kneser-Ney model of trusted text.

Words are predicted from the word before: counts of word pairs are summed over the cluster and stay there
as a sharded table, and each document's pairs are joined with it, shard by shard. Pairs travel packed:
a row holds a shard's sorted pairs of many texts as differences, in as few bytes as the largest needs. Words seen once in trusted text, or
beyond the vocabulary, are one word to these counts and are spelled: by a second model whose grams are of
symbols - letters, and classes of other bytes - with a mark of its own before a word that repeats the one
before. It also predicts the space between words; its grams are so few that each worker has them all. A
document's perplexity is held against a quantile of trusted documents of its language that the models
were not trained on.

A pair's cost is that of its second word after an unseen first one, which each worker knows, less a gain
that pairs seen in trusted text have. So only seen pairs are joined, and a document's gains are summed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checkpoints
from . import words as W

ORDER = 4
QUANTILE = 0.999
#: The limit in nats is the quantile times this: trusted texts are a sample, and clean ones that lie a little beyond them should stay.
MARGIN = 1.1
#: Symbols of the language's mean that every text's mean is drawn to: short texts prove little.
PRIOR = 64
#: One of so many trusted texts is held out of the model for the limits.
HELD_OUT = 5
#: Held-out trusted texts that a language needs for a quantile of its own.
LEAST = 30
#: Trusted ids that are sent to all workers, 8 bytes each; beyond, documents and labels are joined by a shuffle.
MOST_SENT = 8_000_000
#: Words of trusted texts that have ids of their own, the most frequent; below 2 ** 20.
VOCABULARY = 1 << 17
#: Pairs whose gains are sent to all workers, the most frequent ones; all others are joined.
PAIRS_SENT = 1 << 19
#: Shards of the table of pairs at least, and words of trusted texts beyond which there are more.
SHARDS = 32
SHARD_WORDS = 1 << 22
#: Words whose pairs a task counts at once, and pairs of the table in one row.
COUNTED = 1 << 20
ROW_PAIRS = 1 << 18
#: First or second words whose sums lie in one row.
ROW_WORDS = 1 << 12
#: Languages whose means and limits are sent to all workers.
MOST_LANGS = 10_000

# Classes of bytes beside the 26 letters.
_GROUPS = [".,", ";:", "'\"`", "!", "?", "-_", "()[]{}<>", "|", "%*$&#@+=~^\\/"]
_UPPER, _DIGIT, _SPACE, _LINE, _BEYOND, _MARKS = 26, 27, 28, 29, 30, 38
_OTHER = _MARKS + len(_GROUPS)
_AGAIN = _OTHER + 1
SYMBOLS = _AGAIN + 1
# Ids of what has none of its own and of a text's beginning, and the bits of an id in a pair.
_RARE, _BEGIN, _SHIFT = 0, 1, 20


def _symbol(b: int) -> int:
    c = chr(b)
    if 97 <= b <= 122:
        return b - 97
    if 65 <= b <= 90:
        return _UPPER
    if 48 <= b <= 57:
        return _DIGIT
    if b >= 128:
        return _BEYOND + b % 8
    return {" ": _SPACE, "\n": _LINE}.get(c, next((_MARKS + i for i, g in enumerate(_GROUPS) if c in g), _OTHER))


_TABLE = np.array([_symbol(b) for b in range(256)], np.int32)


def grams(column: pa.Array, found: W.Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, one after the other, and where each text's begin. A text starts after line ends."""
    found = found or W.split(column, W.SPACED)
    _, offs = W.buffers(column)
    symbols = _TABLE[found.data]
    again = np.flatnonzero(found.hash[1:] == found.hash[:-1]) + 1
    again = again[~np.isin(again, found.bounds)]
    symbols[found.start[again] - 1] = _AGAIN
    pad, n = ORDER - 1, len(offs) - 1
    padded = np.full(len(symbols) + pad * n, _LINE, np.int32)
    at = np.arange(len(symbols)) + pad * np.repeat(np.arange(1, n + 1), np.diff(offs))
    padded[at] = symbols
    codes = np.zeros(len(symbols), np.int32)
    for j in range(ORDER):
        codes = codes * SYMBOLS + padded[at - pad + j]
    return codes, offs


def _discounts(counts: np.ndarray) -> list[float]:
    return _discounts_of([int((counts == k).sum()) for k in range(1, 5)])


def _discounts_of(n: list[int]) -> list[float]:
    """Modified Kneser-Ney: one discount each for counts of 1, 2 and more, from how many grams have counts of 1 to 4."""
    if 0 in n:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3)]


def _interpolated(level: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
    off = np.array([0.0, *d])[np.minimum(level, 3)]
    total, free = level.sum(axis=-1, keepdims=True), off.sum(axis=-1, keepdims=True)
    return np.where(total > 0, (level - off + free * lower) / np.maximum(total, 1), lower)


def costs(counts: np.ndarray) -> np.ndarray:
    """-ln p(symbol | ORDER - 1 before) for each gram, from the grams' counts. The highest order goes by its first symbol, so that no more than one array of its size is made."""
    levels = [counts.reshape((SYMBOLS,) * ORDER)]
    while levels[-1].ndim > 1:  # below the highest order: in how many contexts a gram continues
        levels.append(np.add.reduce(levels[-1] > 0, axis=0, dtype=np.int64))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for level in levels[:0:-1]:
        p = _interpolated(level, _discounts(level), p)
    d, out = _discounts(counts), np.empty(levels[0].shape, np.float32)
    for i, level in enumerate(levels[0]):
        out[i] = -np.log(_interpolated(level, d, p))
    return out.ravel()


def _among(batch: pa.RecordBatch, ids: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose doc_id is one of the sorted ids; all rows without ids."""
    if ids is None:
        return batch
    own = batch.column(batch.schema.get_field_index("doc_id"))
    value = pc.fill_null(own, 0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, value), max(len(ids) - 1, 0))
    hit = ids[at] == value if len(ids) else np.zeros(len(value), bool)
    return batch.filter(pa.array(hit & own.is_valid().to_numpy(zero_copy_only=False)))


def train(docs: DataFrame, ids: Broadcast | None = None) -> np.ndarray:
    """The table of costs from the texts of docs (doc_id, text), or of those with the given ids. At most SYMBOLS ** ORDER sums reach the driver."""

    def count(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int32)
        for batch in batches:
            for part in W.slices(_among(batch, ids and ids.value), "text"):
                codes, _ = grams(part.column(1))
                kinds, n = np.unique(codes, return_counts=True)
                total[kinds] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["gram", "n"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SYMBOLS**ORDER, np.int64)
    table[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    return costs(table)


def _counted(docs: DataFrame, ids: Broadcast | None, name: str, values) -> DataFrame:
    """How often each of the values that ``values`` makes of a column of texts is in docs, as (name, n)."""

    def count(batches):
        for batch in batches:
            for part in W.slices(_among(batch, ids and ids.value), "text"):
                kinds, n = np.unique(values(part.column(1)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], [name, "n"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(count, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def pairs(found: W.Words, vocabulary: np.ndarray) -> np.ndarray:
    """Of each word the id of the one before, above that of its own; the vocabulary's hashes are sorted."""
    own = np.full(len(found.hash), _RARE, np.int64)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, found.hash), len(vocabulary) - 1)
        own = np.where(vocabulary[at] == found.hash, at + 2, _RARE)
    before = np.concatenate([[_BEGIN], own])[:-1]
    before[found.bounds[:-1][np.diff(found.bounds) > 0]] = _BEGIN
    return before << _SHIFT | own


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes as the largest needs, the lowest bytes of all first, so that bytes alike lie together for Spark's compression."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: pa.BinaryScalar, n: int) -> np.ndarray:
    raw = np.frombuffer(blob.as_buffer(), np.uint8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(raw) // n] = raw.reshape(-1, n).T
    return wide.view("<i8").ravel()


def _steps(codes: np.ndarray) -> bytes:
    """Sorted codes by their differences."""
    return packed(np.diff(codes, prepend=0))


class Shards:
    """Where a pair belongs: its code is v * stride + w, and stride leaves 1 over the number of shards, so the pairs of a frequent word are dealt to all of them."""

    def __init__(self, size: int, n: int):
        self.n, self.stride = n, size + (1 - size) % n

    def codes(self, pair: np.ndarray) -> np.ndarray:
        return (pair >> _SHIFT) * self.stride + (pair & ((1 << _SHIFT) - 1))

    def words(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code // self.stride, code % self.stride

    def dealt(self, code: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by shards and, in a shard, by codes; and each shard's place in it: (shard, from, to)."""
        shard = code % self.n
        order = np.argsort(shard * (self.stride * self.stride // self.n + 1) + code // self.n)
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        return order, [(int(shard[order[i]]), int(i), int(j)) for i, j in zip([0, *cuts], [*cuts, len(order)], strict=True) if i < j]


# A row of counted pairs: of kind _TABLE_ROW a shard's codes and counts, of _WORD_ROW the sums of some words, of _COUNT_ROW how many pairs have each count.
_TABLE_ROW, _WORD_ROW, _COUNT_ROW = range(3)
_COUNTED = "kind int, id int, first long, n int, a binary, b binary"


def _pair_counts(docs: DataFrame, ids: Broadcast | None, vocabulary: np.ndarray, shards: Shards) -> DataFrame:
    """How often each pair is in docs, as packed rows; each shard is summed by one task, which tells the words' sums too."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) + 2

    def dealt(held):
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        order, places = shards.dealt(kinds)
        kinds, n = kinds[order], n[order]
        rows = [(s, j - i, _steps(kinds[i:j] // shards.n), packed(n[i:j])) for s, i, j in places]
        return pa.RecordBatch.from_pylist([dict(zip(("shard", "n", "a", "b"), r, strict=True)) for r in rows], pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]))

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for part in W.slices(_among(batch, ids and ids.value), "text"):
                held.append(shards.codes(pairs(W.split(part.column(1), W.SPACED), known.value)))
                n += len(held[-1])
                if n >= COUNTED:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    def add(table):
        shard, sizes = table.column("shard")[0].as_py(), table.column("n").to_pylist()
        code = np.concatenate([np.cumsum(unpacked(x, n)) for x, n in zip(table.column("a"), sizes, strict=True)])
        count = np.concatenate([unpacked(x, n) for x, n in zip(table.column("b"), sizes, strict=True)])
        order = np.argsort(code)
        code, count = code[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, count = code[first], np.add.reduceat(count, first)
        rows = [(_TABLE_ROW, shard, code[i], _steps(code[i : i + ROW_PAIRS]), packed(count[i : i + ROW_PAIRS]), len(code[i : i + ROW_PAIRS])) for i in range(0, len(code), ROW_PAIRS)]
        v, w = shards.words(code * shards.n + shard)
        sums = [np.bincount(v, count, size).astype(np.int64), *(np.bincount(v[at], minlength=size) for at in (count == 1, count == 2, count > 2)), np.bincount(w, minlength=size)]
        rows += [(_WORD_ROW, k, 0, packed(sums[0][i : i + ROW_WORDS]), packed(np.concatenate([x[i : i + ROW_WORDS] for x in sums[1:]])), len(sums[0][i : i + ROW_WORDS])) for k, i in enumerate(range(0, size, ROW_WORDS))]
        kinds, often = np.unique(np.minimum(count, 1 << 20), return_counts=True)
        rows.append((_COUNT_ROW, 0, 0, packed(kinds), packed(often), len(kinds)))
        kind, id_, start, a, b, n = zip(*rows, strict=True)
        W.release()
        return pa.table([pa.array(kind, pa.int32()), pa.array(id_, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["kind", "id", "first", "n", "a", "b"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(count, "shard int, n int, a binary, b binary").groupBy("shard").applyInArrow(add, _COUNTED)


def _added(table: pa.Table) -> pa.Table:
    """Rows of the same words, summed."""
    n = table.column("n")[0].as_py()
    a, b = (sum(unpacked(x, k * n) for x in table.column(c)) for c, k in (("a", 1), ("b", 4)))
    return pa.table([table.column("id")[:1], table.column("n")[:1], pa.array([packed(a)], pa.binary()), pa.array([packed(b)], pa.binary())], ["id", "n", "a", "b"])


class WordModel:
    """The vocabulary, what a word costs after one that it was never seen after, and the gains of seen pairs: the most frequent ones here, all others in a table.

    p(w | v) = (n - D(n)) / total(v) + free(v) p(w), so a seen pair's -ln p is -ln free(v) - ln p(w), as an unseen
    one's, less ln(1 + (n - D(n)) / (total(v) free(v) p(w))).
    """

    def __init__(self, docs: DataFrame, ids: Broadcast | None, folder: str, vocabulary: int = VOCABULARY, pairs_sent: int = PAIRS_SENT):
        spark = docs.sparkSession
        words = _counted(docs, ids, "word", lambda texts: W.split(texts, W.SPACED).hash).filter("n > 1")
        known = words.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
        self.vocabulary = np.sort(known.column("word").to_numpy().view(np.uint64))
        size = len(self.vocabulary) + 2
        self.shards = shards = Shards(size, max(SHARDS, -(-(pc.sum(known.column("n")).as_py() or 0) // SHARD_WORDS)))
        _pair_counts(docs, ids, self.vocabulary, shards).write.parquet(folder)
        counted = spark.read.parquet(folder)
        sums = np.zeros((5, size), np.int64)  # of each first word all pairs, and the kinds seen once, twice and more; of each second one the kinds
        for row in counted.filter(F.col("kind") == _WORD_ROW).groupBy("id").applyInArrow(_added, "id int, n int, a binary, b binary").toArrow().to_batches():
            for i, n, a, b in zip(*row.columns, strict=True):
                at = slice(i.as_py() * ROW_WORDS, i.as_py() * ROW_WORDS + n.as_py())
                sums[0, at], sums[1:, at] = unpacked(a, n.as_py()), unpacked(b, 4 * n.as_py()).reshape(4, -1)
        counts = counted.filter(F.col("kind") == _COUNT_ROW).select("n", "a", "b").toArrow()
        each = [[unpacked(x, n.as_py()) for n, x in zip(counts.column("n"), counts.column(c), strict=True)] for c in "ab"]
        count, at = np.unique(np.concatenate([*each[0], [0]]), return_inverse=True)
        often = np.bincount(at, np.concatenate([*each[1], [0]])).astype(np.int64)
        self.discounts = d = np.array(_discounts_of([int(often[count == k].sum()) for k in range(1, 5)]))
        all_, off = sums[0], d @ sums[1:4]
        free = np.where(all_ > 0, off / np.maximum(all_, 1), 1.0)
        follows = np.delete(sums[4], _BEGIN)  # after how many words a word is seen
        p = np.insert(_interpolated(follows, _discounts(follows), np.full(size - 1, 1 / (size - 1))), _BEGIN, 1.0)
        self.after, self.alone, self.off, self.p = -np.log(free), -np.log(p), off, p
        falling = np.argsort(-count)
        over = count[falling][np.cumsum(often[falling]) > pairs_sent]
        over = over[over > 0]
        least = int(over.max()) + 1 if len(over) else 1
        table = counted.filter(F.col("kind") == _TABLE_ROW).select("id", "first", "n", "a", "b")

        def frequent(batches):
            for batch in batches:
                for shard, _, n, a, b in zip(*batch.columns, strict=True):
                    times = unpacked(b, n.as_py())
                    at = np.flatnonzero(times >= least)
                    v, w = shards.words(np.cumsum(unpacked(a, n.as_py()))[at] * shards.n + shard.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(v << _SHIFT | w), pa.array(times[at])], ["pair", "n"])

        sent = table.mapInArrow(frequent, "pair long, n long").toArrow()
        order = np.argsort(sent.column(0).to_numpy())
        self.sent = pair = sent.column(0).to_numpy()[order]
        self.gain = self.gains(sent.column(1).to_numpy()[order], pair >> _SHIFT, pair & ((1 << _SHIFT) - 1))
        self.rest = table if len(over) else None

    def gains(self, n: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _gains(n, v, w, self.discounts, self.off, self.p)

    def local(self) -> tuple:
        return self.vocabulary, self.after, self.alone, self.sent, self.gain


def _gains(n: np.ndarray, v: np.ndarray, w: np.ndarray, d: np.ndarray, off: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.log1p((n - d[np.minimum(n, 3) - 1]) / (off[v] * p[w]))


def _found(value: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values are in a sorted array, and whether they are."""
    at = np.minimum(np.searchsorted(among, value), max(len(among) - 1, 0))
    return at, among[at] == value if len(among) else np.zeros(len(value), bool)


def measure(docs: DataFrame, cost: np.ndarray, model: WordModel) -> DataFrame:
    """docs (key, text; rows of one key have one text) to (key, nats, symbols): summed cost, and number of symbols."""
    context, shards, joined = docs.sparkSession.sparkContext, model.shards, model.rest is not None
    sent = context.broadcast((cost, *model.local()))
    facts = context.broadcast((model.discounts, model.off, model.p))

    def own(part):
        """Each text's costs but for the gains of joined pairs, its symbols, and those pairs with their texts."""
        spell, vocabulary, after, alone, frequent, gain = sent.value
        found = W.split(part.column(1), W.SPACED)
        codes, offs = grams(part.column(1), found)
        by_symbol = np.concatenate([[0.0], np.cumsum(spell[codes].astype(np.float64))])
        pair = pairs(found, vocabulary)
        word = pair & ((1 << _SHIFT) - 1)
        nats = after[pair >> _SHIFT] + alone[word] - np.where(word == _RARE, 0.0, by_symbol[found.end] - by_symbol[found.start])
        at, hit = _found(pair, frequent)
        nats[hit] -= gain[at[hit]]
        by_word = np.concatenate([[0.0], np.cumsum(nats)])[found.bounds]
        return np.diff(by_symbol[offs]) + np.diff(by_word), np.diff(offs), pair[~hit], np.repeat(np.arange(part.num_rows), found.counts())[~hit]

    def alone(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                nats, symbols, _, _ = own(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nats), pa.array(symbols)], ["key", "nats", "symbols"])

    names = ["id", "side", "first", "n", "a", "b"]
    schema = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)))

    def asked(batches):
        """Of each slice of texts, named by its place and its keys, a row for each shard with the pairs and their texts, and one with what needs no join."""
        place = 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                nats, symbols, pair, text = own(part)
                key = part.column(0).to_numpy()
                place += 1
                name = xxhash.xxh64_intdigest(np.append(key, [TaskContext.get().partitionId(), place]).tobytes())
                name -= (name >> 63) << 64
                code = shards.codes(pair)
                order, places = shards.dealt(code)
                code, text = code[order] // shards.n, text[order]
                rows = [(s, 1, name, j - i, _steps(code[i:j]), packed(text[i:j])) for s, i, j in places]
                rows.append((place % shards.n, 2, name, len(key), key.tobytes(), nats.tobytes() + symbols.tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    def answer(batches):
        """Rows come by shard, its table first: of each slice's pairs the summed gains of its texts."""
        d, off, p = facts.value
        shard, parts, table = None, [], None
        for batch in batches:
            out = []
            for id_, side, name, n, a, b in zip(*batch.columns, strict=True):
                if id_.as_py() != shard:
                    shard, parts, table = id_.as_py(), [], None
                side, n = side.as_py(), n.as_py()
                if side == 0:
                    parts.append((np.cumsum(unpacked(a, n)), unpacked(b, n).astype(np.int32)))
                elif side == 2:
                    out.append((name.as_py(), -1, a.as_py(), b.as_py()))
                else:
                    if table is None:
                        table = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(2)]
                        parts = []
                    code, text = np.cumsum(unpacked(a, n)), unpacked(b, n)
                    at, hit = _found(code, table[0])
                    if hit.any():
                        v, w = shards.words(code[hit] * shards.n + shard)
                        out.append((name.as_py(), shard, np.bincount(text[hit], _gains(table[1][at[hit]], v, w, d, off, p)).tobytes(), None))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["name", "shard", "a", "b"])
        W.release()

    def total(table):
        """What one slice's texts cost, shard by shard in order."""
        table = table.sort_by("shard")
        if table.column("shard")[0].as_py() != -1 or pc.sum(pc.equal(table.column("shard"), -1)).as_py() != 1:
            raise RuntimeError("the texts came in another order when a task ran again")
        key, both = (np.frombuffer(table.column(c)[0].as_buffer(), np.int64) for c in "ab")
        nats, symbols = both[: len(key)].view(np.float64).copy(), both[len(key) :]
        for x in table.column("a")[1:]:
            gain = np.frombuffer(x.as_buffer(), np.float64)
            nats[: len(gain)] -= gain
        return pa.table([pa.array(key), pa.array(nats), pa.array(symbols)], ["key", "nats", "symbols"])

    docs = docs.select("key", F.col("text").cast("string"))
    if joined:
        table = model.rest.select("id", F.lit(0).alias("side"), "first", "n", "a", "b")
        rows = table.unionByName(docs.mapInArrow(asked, "id int, side int, first long, n int, a binary, b binary"))
        answers = rows.repartition("id").sortWithinPartitions("id", "side", "first").mapInArrow(answer, "name long, shard int, a binary, b binary")
        costs_ = answers.groupBy("name").applyInArrow(total, "key long, nats double, symbols long")
    else:
        costs_ = docs.mapInArrow(alone, "key long, nats double, symbols long")
    return costs_.groupBy("key").agg(F.max("nats").alias("nats"), F.max("symbols").alias("symbols"))


def _chosen(docs: DataFrame, ids: Broadcast | None) -> DataFrame:
    """docs (doc_id first) with the given ids."""
    return docs if ids is None else docs.mapInArrow(lambda batches: (_among(b, ids.value) for b in batches), docs.schema)


def trusted(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> list[tuple[DataFrame, Broadcast | None]]:
    """Of the documents all of whose labels have quality 1 those to train on and those held out (by a hash of the id): a table with the ids to choose from it, or the chosen rows alone if their ids are too many to send."""
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("q")).filter("q = 1")
    own = own.select("_id", (F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(HELD_OUT)) == 0).alias("held")).checkpoint()
    n = own.groupBy("held").count().collect()
    counts = {r["held"]: r["count"] for r in n}
    parts = ["NOT held", "held"] if len(counts) == 2 else ["true", "true"]  # too few to divide
    if sum(counts.values()) > most_sent:
        return [(docs.join(own.filter(p).select("_id"), docs["doc_id"] == F.col("_id"), "left_semi"), None) for p in parts]
    context = docs.sparkSession.sparkContext
    return [(docs, context.broadcast(np.sort(own.filter(p).select("_id").toArrow().column(0).to_numpy()))) for p in parts]


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most_sent: int = MOST_SENT, vocabulary: int = VOCABULARY, pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """docs (doc_id, text, lang and any columns) with perplexity, threshold and keep.

    perplexity is exp of the mean cost of a symbol, of words and spaces together, drawn to the language's mean by PRIOR symbols;
    threshold lies by MARGIN above the quantile of the held-out trusted texts of the language, or of all
    where they are fewer than LEAST. Null and empty texts take the language's mean and stay; a null lang is a language like the
    others. Without trusted texts all stay. Repeated rows are judged each; columns named as the result's
    are replaced, all others stay as they are.
    """
    spark = docs.sparkSession
    folder = f"{checkpoints.ensure(spark)}/pairs-{uuid.uuid4().hex}"
    base = docs.drop("perplexity", "threshold", "keep")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key")
    (good, ids), (held, held_ids) = trusted(base.select(F.col("doc_id").cast("long"), "lang", "text", key), labels, most_sent)
    scored = measure(base.select(key, "text"), train(good, ids), WordModel(good, ids, folder, vocabulary, pairs_sent)).checkpoint()
    checkpoints.remove(spark, folder)
    measured = _chosen(held.select("doc_id", "lang", "key"), held_ids).join(scored, "key").select("lang", "nats", "symbols").checkpoint()
    means = measured.groupBy("lang").agg((F.sum("nats") / F.nullif(F.sum("symbols"), F.lit(0))).alias("mean"))
    every = measured.agg((F.sum("nats") / F.nullif(F.sum("symbols"), F.lit(0))).alias("mean")).first()["mean"] or 0.0
    value = (F.col("nats") + PRIOR * F.coalesce("mean", F.lit(every))) / (F.col("symbols") + PRIOR)
    own = measured.withColumnRenamed("lang", "own")
    valued = own.join(means, own["own"].eqNullSafe(means["lang"]), "left").select("own", value.alias("value"))
    limit = F.percentile_approx("value", quantile, 100_000)
    limits = valued.groupBy("own").agg(limit.alias("limit"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    at_all = valued.agg(limit.alias("limit")).first()["limit"]
    facts = means.join(limits, means["lang"].eqNullSafe(limits["own"]), "left").select(F.col("lang").alias("_lang"), "mean", "limit").checkpoint()
    # columns of docs lie in a struct, so that theirs and the inner ones may bear the same names
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns if c != "text"]).alias("row"), "lang", F.col("text").cast("string").alias("text"), key).join(scored, "key")
    joined = rows.join(F.broadcast(facts) if facts.count() <= MOST_LANGS else facts, rows["lang"].eqNullSafe(F.col("_lang")), "left")
    bound = F.coalesce("limit", F.lit(float("inf") if at_all is None else at_all)) * MARGIN
    kept = [F.col("text").cast(base.schema["text"].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in base.columns]
    return joined.select(*kept, F.exp(value).alias("perplexity"), F.exp(bound).alias("threshold"), (value <= bound).alias("keep"))
