"""Masked pseudo-likelihood by a bidirectional window network in numpy.

Each token is predicted from the tokens on both sides of it; a document's score is the sum of the
conditional log-probabilities. The vocabulary and its class layout come from the counts of all
documents. In every round each task trains a copy of the network on masked tokens of all its
documents, and the copies are averaged by a tree of partial sums, so no node gathers them all. The
rounds take turns, so that every token of the corpus is a target. What a task learns follows from the
rows it gets, in their order: the same tables in other files or partitions give slightly other scores.

Output is factored: the class of a token first, then the token within its class. Words that share an
id have a third factor, ln p(word | id) from the exact counts of all texts, so every word of a corpus
of any size has a probability of its own. The most frequent of these words go to all workers; the rest
meet their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checkpoints
from . import words as W

#: Words with an id of their own; the others share OTHERS ids by hash.
VOCABULARY = 1984
OTHERS = 63
#: Words sharing ids whose counts all workers hold; beyond, counts are joined.
SENT = 1 << 17
#: Bytes that words are made of (W.ALNUM after folding), and the end of a word.
SPELLING = 10 + 26 + 128 + 1
WINDOW = 2
WIDTH = 16
ROUNDS = 2
#: Times that each token is masked and predicted, spread over the rounds.
PASSES = 1
BATCH = 4096
RATE = 0.15
SEED = 20
#: Numbers below this, either sign, go to exp as they are.
BEARABLE = 60


class Lookup:
    """Where hashes lie among sorted ones: the leading bits say where to begin, so most are found at once."""

    def __init__(self, keys: np.ndarray):
        self.n, self.shift = len(keys), np.uint64(63 - len(keys).bit_length())
        starts = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(keys, starts)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        at = self.starts[hashes >> self.shift]
        live = np.flatnonzero(self.keys[at] < hashes)
        while len(live):
            at[live] += 1
            live = live[self.keys[at[live]] < hashes[live]]
        return at, (self.keys[at] == hashes) & (at < self.n)


@dataclass
class Vocabulary:
    """Sorted hashes of the chosen words and the id of each; ids are 1 and up by falling count, then the shared ones. 0 stands outside a text."""

    key: np.ndarray
    id: np.ndarray
    size: int
    #: Sorted hashes of the most frequent words that share ids, and ln p(word | id) of each.
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    often_log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of each shared id: ln(tokens + unseen), and ln of the share of words not seen.
    total_log: np.ndarray = field(default_factory=lambda: np.zeros(OTHERS))
    unseen_log: np.ndarray = field(default_factory=lambda: np.zeros(OTHERS))
    #: word, n of the words with shared ids that are not among ``often``; None if there are none.
    rare: DataFrame | None = None

    @property
    def side(self) -> int:
        """Classes, and tokens in a class: ids are laid in a square by rank."""
        return int(np.ceil(np.sqrt(self.size)))

    @cached_property
    def _own(self) -> Lookup:
        return Lookup(self.key)

    @cached_property
    def _often(self) -> Lookup:
        return Lookup(self.often)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at, there = self._own.find(hashes)
        out = np.append(self.id, 0)[at]
        other = np.flatnonzero(~there)
        out[other] = 1 + len(self.key) + (hashes[other] % np.uint64(OTHERS)).astype(np.int64)
        return out

    def within(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln p(word | id) as if words not among ``key`` and ``often`` were not seen, and which these are.

        The share of words not seen is dealt by spelling: each byte, and the end, is one of SPELLING.
        """
        out, left = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        other = np.flatnonzero(~self._own.find(hashes)[1])
        shared = hashes[other]
        at, there = self._often.find(shared)
        guess = self.unseen_log[(shared % np.uint64(OTHERS)).astype(np.int64)] - (sizes[other] + 1) * np.log(SPELLING)
        guess[there] = self.often_log[at[there]]
        out[other], left[other] = guess, ~there
        return out, left


def _bucket() -> Column:
    """The shared id of ``word``, from 0: its hash is unsigned."""
    return F.pmod(F.col("word") % OTHERS + F.when(F.col("word") < 0, pow(2, 64, OTHERS)).otherwise(0), F.lit(OTHERS)).cast("int")


def vocabulary(docs: DataFrame, size: int = VOCABULARY, sent: int = SENT) -> Vocabulary:
    """The most frequent words of all texts, counted exactly, and the probabilities of all others within their shared ids."""

    def count(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                kinds, n = np.unique(W.split(part.column(0), W.ALNUM).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    top = counted.orderBy(F.desc("n"), "word").limit(size + sent).toArrow()
    word, n = (top.column(c).to_numpy() for c in ("word", "n"))
    rank = np.lexsort((word, -n))
    word, n = word[rank].view(np.uint64), n[rank]
    key, order = word[:size], np.argsort(word[:size])
    tokens, once = np.zeros(OTHERS), np.ones(OTHERS)  # an unseen word is as likely as the words seen once, and possible in any case
    for r in counted.groupBy(_bucket().alias("b")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
        tokens[r["b"]] += r["n"]
        once[r["b"]] += r["once"]
    shared = (key % np.uint64(OTHERS)).astype(np.int64)
    np.subtract.at(tokens, shared, n[:size])
    np.subtract.at(once, shared, n[:size] == 1)
    total_log = np.log(tokens + once)
    often, often_n = word[size:], n[size:]
    by_hash = np.argsort(often)
    often_log = np.log(often_n) - total_log[(often % np.uint64(OTHERS)).astype(np.int64)]
    rare = None
    if len(word) == size + sent:
        last, last_word = int(n[-1]), int(word[-1:].view(np.int64)[0])
        rare = counted.filter((F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > last_word)))
    return Vocabulary(key[order], order + 1, 1 + len(key) + OTHERS, often[by_hash], often_log[by_hash], total_log, np.log(once) - total_log, rare)


class Network:
    """A token's neighbours add their vectors, one table for each place, to a hidden layer of tanh; from there class and token."""

    def __init__(self, size: int, side: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.side = side
        self.weights = {"near": f(2 * WINDOW, size, WIDTH), "bias": np.zeros(WIDTH, np.float32), "group": f(WIDTH, side), "group_bias": np.zeros(side, np.float32), "word": f(side, WIDTH, side), "word_bias": np.zeros((side, side), np.float32)}

    def _forward(self, near: np.ndarray, token: np.ndarray):
        """Of the tokens in the order of their classes: that order, neighbours by place, class and word, hidden layer with a 1 behind it, weights with their biases, and what class and word come to before normalising."""
        w, n = self.weights, len(token)
        group = token // self.side
        order = _order(group)
        near, group = np.take(near.T, order, axis=1), group[order]
        word = token[order] - group * self.side
        total = w["near"][0].take(near[0], axis=0)
        for j in range(1, 2 * WINDOW):
            total += w["near"][j].take(near[j], axis=0)
        total += w["bias"]
        h = np.ones((n, WIDTH + 1), total.dtype)
        np.tanh(total, out=h[:, :WIDTH])
        to_group = np.vstack([w["group"], w["group_bias"]])
        to_word = np.concatenate([w["word"], w["word_bias"][:, None]], axis=1)
        cuts = np.searchsorted(group, np.arange(self.side + 1))
        parts = [(g, slice(cuts[g], cuts[g + 1])) for g in np.flatnonzero(np.diff(cuts))]
        words = np.empty((n, self.side), total.dtype)
        for g, own in parts:
            np.matmul(h[own], to_word[g], out=words[own])
        groups = _level(h @ to_group, to_group)
        return order, near, group, word, h, to_group, to_word, parts, groups, _level(words, to_word)

    def log_prob(self, near: np.ndarray, token: np.ndarray) -> np.ndarray:
        """ln p(token | neighbours); near has the ids before and after, nearest last and first."""
        order, _, group, word, *_, groups, words = self._forward(near, token)
        rows, one, out = np.arange(len(token)), np.ones(self.side, groups.dtype), np.empty(len(token))
        told = groups[rows, group].astype(np.float64) + words[rows, word]
        for z in (groups, words):
            told -= np.log(np.exp(z, out=z) @ one)
        out[order] = told
        return out

    def gradients(self, near: np.ndarray, token: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Of the mean cost of a batch: those of the dense weights, and per place the rows of ``near`` that occur with theirs."""
        _, near, group, word, h, to_group, to_word, parts, p, q = self._forward(near, token)
        n, one = len(token), np.ones(self.side, h.dtype)
        for z, at in ((p, group), (q, word)):
            np.exp(z, out=z)
            total = z @ one
            total *= n
            z /= total[:, None]
            z[np.arange(n), at] -= 1 / n
        dgroup, dword, dh = h.T @ p, np.zeros_like(to_word), np.empty_like(h[:, :WIDTH], order="C")
        for g, own in parts:
            np.matmul(q[own], to_word[g, :WIDTH].T, out=dh[own])
            np.matmul(h[own].T, q[own], out=dword[g])
        dh += p @ to_group[:WIDTH].T
        dh *= 1 - h[:, :WIDTH] ** 2
        grad = {"group": dgroup[:WIDTH], "group_bias": dgroup[WIDTH], "word": dword[:, :WIDTH], "word_bias": dword[:, WIDTH], "bias": np.ones(n, dh.dtype) @ dh}
        places = []
        for ids in near:
            order = _order(ids)
            rows = ids[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            places.append((rows[first], np.add.reduceat(dh.take(order, axis=0), first)))
        return grad, places

    def step(self, near: np.ndarray, token: np.ndarray, square: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step on a batch."""
        w = self.weights
        grad, places = self.gradients(near, token)
        for k, g in grad.items():
            square[k] += g * g
            w[k] -= rate * g / np.sqrt(square[k])
        for j, (at, g) in enumerate(places):
            square["near"][j, at] += g * g
            w["near"][j, at] -= rate * g / np.sqrt(square["near"][j, at])

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.weights.items():
            self.weights[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def _order(ids: np.ndarray) -> np.ndarray:
    """A stable order; small ids sort by their digits."""
    return np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")


def _level(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows that exp can bear: less their largest, unless the weights (what they are multiplied with is 1 at most) bound them."""
    if not np.abs(weights).sum(axis=-2).max() < BEARABLE:
        z -= z.max(axis=1, keepdims=True)
    return z


def windows(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with WINDOW zeros around each text, the place of each token there, and the texts' bounds among the tokens."""
    return _laid(column, vocab)[:3]


def _laid(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, W.Words]:
    found = W.split(column, W.ALNUM)
    n = len(column)
    at = np.arange(len(found.hash)) + WINDOW * np.repeat(np.arange(1, n + 1), found.counts())
    line = np.zeros(len(found.hash) + WINDOW * (n + 1), np.int64)
    line[at] = vocab.ids(found.hash)
    return line, at, found.bounds, found


def _near(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line[at + d] for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1))]).T


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, passes: int = PASSES) -> np.ndarray:
    """The averaged weights. Every token is a target in ``passes`` of the rounds."""
    spark = docs.sparkSession
    flat = Network(vocab.size, vocab.side).pack()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    vocab = replace(vocab, rare=None)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocab, flat))

        def learn(batches, sent=sent, turn=turn):
            own, start = sent.value
            net = Network(own.size, own.side).unpack(start)
            square = {k: np.full_like(v, 1e-4) for k, v in net.weights.items()}
            seen = 0
            for batch in batches:
                for part in W.slices(batch, "text"):
                    line, at, _ = windows(part.column(0), own)
                    rng = np.random.default_rng([len(at), int(line.sum())])
                    at = at[(rng.permutation(len(at)) - turn) % rounds < passes]
                    rng.shuffle(at)
                    for i in range(0, len(at), BATCH):
                        own_at = at[i : i + BATCH]
                        net.step(_near(line, own_at), line[own_at], square)
                    seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.pack().tobytes()], pa.binary())], ["seen", "weights"])

        flat = _mean(texts.mapInArrow(learn, "seen long, weights binary").checkpoint(), flat)
    return flat


def _mean(copies: DataFrame, otherwise: np.ndarray, fan: int = 8) -> np.ndarray:
    """The mean of all copies by tokens seen: sums of about ``fan`` copies each, until a few are left for the driver."""

    def add(batches):
        total, seen = None, 0
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(raw.as_buffer(), np.float32) * np.float64(n)
                total, seen = value if total is None else total + value, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], ["seen", "weights"])

    n = copies.count()
    while n > fan:
        n = -(-n // fan)
        copies = copies.repartition(n).mapInArrow(add, "seen long, weights binary").checkpoint()
    rows = copies.collect()
    total = sum(r["seen"] for r in rows)
    return sum(np.frombuffer(r["weights"], np.float32) * (r["seen"] / total) for r in rows).astype(np.float32) if total else otherwise


def _key() -> list[Column]:
    """A text's 128 bits: what is added to its score follows from the text alone."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(SEED), text).alias("_k2")]


def _rare(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """_k1, _k2 and _more of each text with words of vocab.rare: what their counts give beyond the unseen words' probability."""
    sent = docs.sparkSession.sparkContext.broadcast(replace(vocab, rare=None))

    def find(batches):
        own = sent.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.split(part.column(2), W.ALNUM)
                guess, left = own.within(found.hash, found.end - found.start)
                place = np.flatnonzero(left)
                text = np.searchsorted(found.bounds, place, "right") - 1
                counts = np.bincount(text, minlength=part.num_rows)
                rows = np.flatnonzero(counts)
                offsets = np.concatenate([[0], np.cumsum(counts[rows])]).astype(np.int32)
                words = pa.ListArray.from_arrays(offsets, pa.array(found.hash[place].view(np.int64)))
                guesses = pa.ListArray.from_arrays(offsets, pa.array(guess[place]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), words, guesses], ["_k1", "_k2", "words", "guesses"])

    texts = docs.select(*_key(), F.col("text").cast("string").alias("text"))
    bags = texts.mapInArrow(find, "_k1 long, _k2 long, words array<long>, guesses array<double>").dropDuplicates(["_k1", "_k2"])
    each = bags.select("_k1", "_k2", F.explode(F.arrays_zip("words", "guesses")).alias("e")).select("_k1", "_k2", F.col("e.words").alias("word"), F.col("e.guesses").alias("guess"))
    total = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.total_log]), _bucket() + 1)
    met = each.join(vocab.rare, "word").withColumn("more", F.log("n") - total - F.col("guess"))
    return met.groupBy("_k1", "_k2").agg(F.sum("more").alias("_more"))


def score(docs: DataFrame, vocab: Vocabulary, flat: np.ndarray) -> DataFrame:
    """docs (text and any columns) with tokens, log_likelihood (the sum) and mean_log_likelihood (null without tokens)."""
    base = docs.drop("tokens", "log_likelihood", "mean_log_likelihood").withColumns({"tokens": F.lit(0).cast("long"), "log_likelihood": F.lit(0.0)})
    names = base.columns
    if vocab.rare is not None:
        base = base.select("*", *_key())
    sent = docs.sparkSession.sparkContext.broadcast((replace(vocab, rare=None), flat))

    def judge(batches):
        own, weights = sent.value
        net = Network(own.size, own.side).unpack(weights)
        for batch in batches:
            for part in W.slices(batch, "text"):
                column = dict(zip(part.schema.names, part.columns, strict=True))
                line, at, bounds, found = _laid(column["text"], own)
                value = np.zeros(len(at) + 1)
                value[1:] = own.within(found.hash, found.end - found.start)[0]
                for i in range(0, len(at), 1 << 14):
                    own_at = at[i : i + (1 << 14)]
                    value[i + 1 : i + 1 + len(own_at)] += net.log_prob(_near(line, own_at), line[own_at])
                total = np.cumsum(value)
                column |= {"tokens": pa.array(np.diff(bounds)), "log_likelihood": pa.array(total[bounds[1:]] - total[bounds[:-1]])}
                yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    out = base.mapInArrow(judge, base.schema)
    if vocab.rare is not None:
        out = out.join(_rare(docs, vocab), ["_k1", "_k2"], "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0))).select(*names)
    return out.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("tokens"), F.lit(0)))


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on all texts of docs and score each.

    Null and empty texts have no tokens and a sum of 0; without any token the untrained network
    stands. Repeated rows are trained on and scored each; columns named as the result's are replaced.
    """
    checkpoints.ensure(docs.sparkSession)
    vocab = vocabulary(docs)
    return score(docs, vocab, train(docs, vocab, rounds))
