"""Phrase collocations: candidates from sketch upper bounds, exact counts by automata, scores by integer arithmetic.

Grams of one length after the other are counted in a count-min sketch of one row, whose cells follow the
corpus in number and are dealt to shards that sum them. A gram is only counted where the grams within it
may reach the least count, so most of the corpus is out after two lengths. Cells that reach it go to all
workers as bits of a bounded map: a phrase may be taken for a candidate wrongly, never left out.

Some texts at a time are matched with an Aho-Corasick automaton of the candidates that occur in them, so
automata are bounded by the texts at hand and not by the number of all candidates, and one reading counts
everything. A key has a blank on both sides of every word, as the normalised texts have, so only whole
words match; all overlapping matches count. Counts are summed by shards, and the thresholds apply to the
sums.
"""

from __future__ import annotations

from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import checkpoints
from . import words as W

#: What ends a piece.
BREAKS = ".,;:!?\n\x0b\x0c\r"
#: Bits of the map of cells that reach the least count: a bounded broadcast, 16 MB.
MAP_BITS = 27
#: Cells of one shard of the sketch.
SHARD_BITS = 22
#: Grams that a worker holds before it sums them up.
HELD = 1 << 21
#: Characters of distinct candidates beyond which a task builds its automata: about 60 bytes of memory each.
BLOCK = 1 << 22
#: Bytes of texts that a task holds for its automata.
READ = 1 << 24
#: Parts of a language that are ranked apart before the last ranking.
RANKED = 64

_WORD = W.Alphabet(lambda b: b not in (9, 32, *BREAKS.encode()), W._lower)
_ENDS = np.isin(np.arange(256), list(BREAKS.encode()))
#: Bytes of a text before its words are taken: folded, and a full stop, which no word holds, for what ends a piece.
_FOLD = bytes(46 if _ENDS[b] else W._lower(b) for b in range(256))


def _packed(at: np.ndarray, count: np.ndarray) -> tuple[bytes, int]:
    """Sorted places with their counts in few bytes, and how many these are unpacked. Gaps have two bytes, larger ones are stepped over; counts have one, larger ones are listed."""
    gap = np.diff(at, prepend=0)
    steps = gap // 65535
    here = np.cumsum(steps + 1) - 1
    gaps, small = np.full(int(steps.sum()) + len(at), 65535, np.uint16), np.zeros(int(steps.sum()) + len(at), np.uint8)
    gaps[here], small[here] = gap % 65535, np.minimum(count, 255)
    parts = [np.array([len(gaps)]), gaps.astype(np.uint8), (gaps >> 8).astype(np.uint8), small, count[count >= 255].astype(np.int64)]
    body = b"".join(p.tobytes() for p in parts)
    return pa.compress(body, "zstd", asbytes=True), len(body)


def _unpacked(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(body, size, "zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    low, high, small = np.frombuffer(data, np.uint8, 3 * n, 8).reshape(3, n).astype(np.int64)
    small[small == 255] = np.frombuffer(data, np.int64, -1, 8 + 3 * n)
    return np.cumsum(low + (high << 8)), small


class _Grams:
    """The words of some texts with their languages, and the hash of every gram within a piece."""

    def __init__(self, texts: pa.Array, lang: pa.Array):
        self.found = found = W.split(texts, _WORD)
        self.own = np.repeat(np.arange(len(texts)), found.counts())
        ends = np.concatenate([[0], np.cumsum(_ENDS[found.data])])[found.start]
        self.first = np.ones(len(found.start), bool)
        self.first[1:] = (self.own[1:] != self.own[:-1]) | (ends[1:] != ends[:-1])
        names = lang.dictionary_encode()
        seeds = W.split(names.dictionary, W.Alphabet(lambda b: True))
        seed = np.zeros(len(names.dictionary), np.uint64)
        full = np.flatnonzero(seeds.counts())
        seed[full] = seeds.hash
        self.lang = names
        self.hash = W.mix(found.hash + W.mix(seed)[names.indices.to_numpy()][self.own]) if len(self.own) else found.hash

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of k words from each place, and whether they lie in one piece."""
        hashes = W.grams(self.hash, k)
        whole = np.ones(len(hashes), bool)
        for i in range(1, k):
            whole &= ~self.first[i : i + len(hashes)]
        return hashes, whole


class Bounds:
    """Which grams may reach the least count, by a bit for each cell of the sketch that does. Grams of a length that was not counted may."""

    def __init__(self, map_bits: int = MAP_BITS) -> None:
        self.map_bits = map_bits
        self.bits: dict[int, np.ndarray] = {}

    def add(self, k: int, place: np.ndarray, word: np.ndarray) -> None:
        """Words of 64 bits of the map, and their places."""
        bits = np.zeros(1 << self.map_bits - 6, np.uint64)
        bits[place] = word.view(np.uint64)
        self.bits[k] = bits

    def holds(self, k: int, cell: np.ndarray) -> np.ndarray:
        if k not in self.bits:
            return np.ones(len(cell), bool)
        at = cell & np.uint64((1 << self.map_bits) - 1)
        return (self.bits[k][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def possible(self, grams: _Grams, longest: int, cells: int):
        """(k, hashes, where a gram of k words may reach the least count as far as is known) for each k."""
        before = None
        for k in range(1, longest + 1):
            hashes, ok = grams.of(k)
            if before is not None:
                ok &= before[: len(ok)] & before[1 : len(ok) + 1]
            at = np.flatnonzero(ok)
            at = at[self.holds(k, hashes[at] & np.uint64(cells - 1))]
            before = np.zeros(len(hashes), bool)
            before[at] = True
            yield k, hashes, at


def _tidy(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _slices(batches):
    for batch in batches:
        for part in W.slices(batch, "text"):
            yield part.column(0), part.column(1)


def _totals(texts: DataFrame) -> DataFrame:
    """(lang, n) with the words of each language."""

    def count(batches):
        for lang, text in _slices(batches):
            yield pa.RecordBatch.from_arrays([lang, pa.array(W.split(text, _WORD).counts())], ["lang", "n"])

    return texts.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _summed_in(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cell, count = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return cell[start], np.add.reduceat(count, start) if len(start) else count[:0]


def _reaching(texts: DataFrame, lengths: tuple[int, ...], known: Bounds, cells: int, least: int, shard_bits: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The cells of each length's sketch that reach ``least``, as words of the map and their places: each task sums its own, then each shard."""
    sent = texts.sparkSession.sparkContext.broadcast(known)
    shards, map_bits = max(1, cells >> shard_bits), known.map_bits
    inside = np.uint64(cells // shards - 1)

    def count(batches):
        held: dict[int, tuple[list, list]] = {k: ([], []) for k in lengths}
        size = 0

        def out():
            for k, (c, n) in held.items():
                if not c:
                    continue
                cell, total = _summed_in(c, n)
                cuts = np.searchsorted(cell, np.arange(shards + 1, dtype=np.uint64) * (inside + np.uint64(1)))
                full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                bodies = [_packed((cell[cuts[s] : cuts[s + 1]] & inside).astype(np.int64), total[cuts[s] : cuts[s + 1]]) for s in full]
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(full), pa.int32()), "shard": pa.array(full, pa.int64()), "body": pa.array([b for b, _ in bodies], pa.binary()), "size": pa.array([n for _, n in bodies], pa.int64())})
                held[k] = ([], [])

        for lang, text in _slices(batches):
            for k, hashes, at in sent.value.possible(_Grams(text, lang), max(lengths), cells):
                if k in held:
                    cell, total = np.unique(hashes[at] & np.uint64(cells - 1), return_counts=True)
                    held[k][0].append(cell)
                    held[k][1].append(total)
                    size += len(cell)
            if size > most:
                yield from out()
                size = 0
        yield from out()

    def total(key, part):
        k, shard = (x.as_py() for x in key)
        sums = np.zeros(int(inside) + 1, np.int64)
        for body, size in zip(part["body"], part["size"], strict=True):
            where, count = _unpacked(body.as_py(), size.as_py())
            sums[where] += count
        bit = (np.flatnonzero(sums >= least) + shard * (int(inside) + 1)) & ((1 << map_bits) - 1)
        place, word = bit >> 6, np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
        return pa.Table.from_pydict({"k": pa.array(np.full(len(bit), k, np.int32)), "place": pa.array(place), "word": pa.array(word.view(np.int64))})

    parts = texts.mapInArrow(count, "k int, shard long, body binary, size long")
    words = parts.groupBy("k", "shard").applyInArrow(total, "k int, place long, word long").groupBy("k", "place").agg(F.bit_or("word").alias("word"))
    found = words.toArrow()  # no more rows than the map has words
    k, place, word = (found[c].to_numpy() for c in ("k", "place", "word"))
    return {length: (place[k == length], word[k == length]) for length in lengths}


def normalised(text: bytes) -> str:
    """Words with a blank on either side; where a piece ends, a full stop stands among them."""
    return f" {b' '.join(text.translate(_FOLD).replace(b'.', b' . ').split()).decode()} "


def _occurrences(phrases: list[bytes], texts: list[str]) -> np.ndarray:
    """How often each phrase occurs in normalised texts, by an automaton of all of them."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        auto.add_word(f" {phrase.decode()} ", i)
    auto.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), auto.iter(".".join(texts))), np.int64), minlength=len(phrases))


def _told(phrases: list[bytes], counts: np.ndarray) -> bytes:
    """Phrases with their counts: one byte each, larger ones are listed."""
    large = counts[counts >= 255].astype(np.int64)
    return b"".join([np.array([len(phrases), len(large)]).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes(), b"\n".join(phrases)])


def _heard(data: bytes) -> tuple[list[bytes], np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    counts = np.frombuffer(data, np.uint8, n, 16).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, m, 16 + n)
    return data[16 + n + 8 * m :].split(b"\n"), counts


def _counts(texts: DataFrame, known: Bounds, cells: int, longest: int, least: int, shard_bits: int, block: int, read: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of 1 to ``longest`` words that occur ``least`` times, blanks between words.

    A task holds texts until these have ``read`` bytes or their distinct candidates ``block`` characters, builds
    automata of these candidates, which are all that occur there, and sends their counts to shards that sum them. So
    texts are read once, whatever the number of all candidates, and no list of these is gathered.
    """
    sent = texts.sparkSession.sparkContext.broadcast(known)
    shards = np.uint64(max(64, cells >> shard_bits))

    def count(batches):
        told, found, bodies = {}, {}, {}
        size = held = 0

        def out():
            for lang, some in found.items():
                some.sort()
                sums = _occurrences([p for _, p in some], bodies[lang])
                shard = np.array([s for s, _ in some])
                full, start = np.unique(shard, return_index=True)
                data = [_told([p for _, p in some[x:y]], sums[x:y]) for x, y in zip(start.tolist(), [*start[1:].tolist(), len(some)], strict=True)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(full), pa.string()), "shard": pa.array(full.astype(np.int64)), "body": pa.array([pa.compress(d, "zstd", asbytes=True) for d in data], pa.binary()), "size": pa.array([len(d) for d in data], pa.int64())})
            for x in (told, found, bodies):
                x.clear()

        for lang, text in _slices(batches):
            grams = _Grams(text, lang)
            names, of = grams.lang.dictionary.to_pylist(), grams.lang.indices.to_numpy()
            folded = _WORD.fold[grams.found.data]
            for k, hashes, at in sent.value.possible(grams, longest, cells):
                new, once = np.unique(hashes[at], return_index=True)
                before = told.get(k, np.zeros(0, np.uint64))
                place = np.searchsorted(before, new)
                fresh = before[np.minimum(place, len(before) - 1)] != new if len(before) else np.ones(len(new), bool)
                told[k] = np.insert(before, place[fresh], new[fresh])
                for i, shard in zip(at[once[fresh]].tolist(), (new[fresh] % shards).tolist(), strict=True):
                    phrase = b" ".join(folded[grams.found.start[j] : grams.found.end[j]].tobytes() for j in range(i, i + k))
                    found.setdefault(names[of[grams.own[i]]], []).append((shard, phrase))
                    size += len(phrase) + 2
            data, bounds = W.buffers(text)
            for i, j in enumerate(of.tolist()):
                bodies.setdefault(names[j], []).append(normalised(data[bounds[i] : bounds[i + 1]].tobytes()))
            held += len(data)
            if size > block or held > read:
                yield from out()
                size = held = 0
        yield from out()
        W.release()

    def total(key, part):
        sums: dict[bytes, int] = {}
        for body, size in zip(part["body"], part["size"], strict=True):
            phrases, counts = _heard(pa.decompress(body.as_py(), size.as_py(), "zstd", asbytes=True))
            for phrase, n in zip(phrases, counts.tolist(), strict=True):
                sums[phrase] = sums.get(phrase, 0) + n
        often = sorted((p, n) for p, n in sums.items() if n >= least)
        return pa.table([pa.array([key[0].as_py()] * len(often), pa.string()), pa.array([p for p, _ in often], pa.binary()).cast(pa.string()), pa.array([n for _, n in often], pa.int64())], ["lang", "phrase", "n"])

    return texts.mapInArrow(count, "lang string, shard long, body binary, size long").groupBy("lang", "shard").applyInArrow(total, "lang string, phrase string, n long")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, block: int = BLOCK, map_bits: int = MAP_BITS, shard_bits: int = SHARD_BITS, held: int = HELD, read: int = READ) -> DataFrame:
    """docs (lang, text) to (lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to ``longest`` words.

    A-Z are lower-cased; ``BREAKS`` end pieces, blanks and tabs words. a is how often a phrase occurs within
    pieces, overlaps included, at least ``least`` times; n counts the language's words. Of its cuts in two,
    l and r times, that with the lowest 1000 a n / (l r), rounded down, counts, of equals the one after
    fewest words. A phrase within a longer one that is as frequent is left out. Equal scores rank by a, then
    by the phrase's bytes. Null languages are "und"; null and empty texts have no words; ids and repeated
    rows don't matter, each row counts; other columns are ignored. Counts are exact; arithmetic is in 38
    digits.
    """
    checkpoints.ensure(docs.sparkSession)
    texts = _tidy(docs)
    totals = _totals(texts).checkpoint()
    words = totals.agg(F.sum("n")).first()[0] or 0
    cells = 1 << min(62, max(16, words.bit_length()))
    known = Bounds(map_bits)
    for lengths in ((1,), (2,), tuple(range(3, longest + 1))):
        if lengths and max(lengths) <= longest:
            for k, words_of in _reaching(texts, lengths, known, cells, least, shard_bits, held).items():
                known.add(k, *words_of)
    counts = _counts(texts, known, cells, longest, least, shard_bits, block, read).checkpoint()
    return ranked(counts, totals, first)


def ranked(counts: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    """Exact counts (lang, phrase, n) of phrases and their parts, and words by language, to the best collocations."""
    counts = counts.withColumn("words", F.split("phrase", " ", -1))
    size = F.size("words")
    longer = counts.filter(size > 2).select("lang", "n", "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("k"))
    inner = longer.select("lang", "n", F.explode(F.expr("transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = counts.filter(size > 1).join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < n")
    cut = alone.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("right"))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    scored = cut.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn("score", F.expr("(cast(1000 * _a as decimal(19,0)) * _n) div (_l * _r)").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    some = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    some = some.withColumn("rank", place("_part")).filter(F.col("rank") <= first)
    return some.withColumn("rank", place()).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
