"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, on block-max inverted lists.

All words of the labelled texts are terms. A term's idf is weighed by how much it tells of the label
(chi-square, for terms that lean to label 1; others keep a small share), and one term that every text
has weighs evidence against none. Examples lie in blocks. A rare term's list goes by block, each with
the largest weight there; the few terms that most texts have are columns of all examples. Both give
bounds of a block's scores: a text's two best blocks are scored first, then only those blocks whose
bound reaches the k-th score, so the search is exact. Neighbours vote by distance.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checkpoints
from . import words as W

#: Labelled documents that are learned from: those with the smallest hashes of their ids, at most so many, with at most so many distinct words in all.
MAX_EXAMPLES = 8000
MAX_POSTINGS = 4_000_000
#: Chi-square at which a term's idf counts half, the steepness beyond, and the share that every term keeps.
HALF = 4.0
STEEP = 4
LEAST_SHARE = 0.05
COMMON_WEIGHT = 2.0
NEIGHBOURS = 9
BLOCK = 128
#: Terms in more than this share of the examples are columns.
FREQUENT = 0.05
#: Bytes of text that are scored at once.
SLICE_BYTES = 1 << 18


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the words; sorted by text, then term."""
    found = W.split(column, W.ALNUM)
    text, term = np.repeat(np.arange(len(column)), found.counts()), found.hash
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return text[at], term[at], np.diff(np.append(at, len(text)))


def _expand(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges (low, size), and the range of each."""
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which


@dataclass
class Model:
    """Terms (sorted) with their weights; per example its document and label.

    Of term t, entries ``first[t]:first[t + 1]`` name the blocks that have it, with the largest weight in
    each, and entry e's postings are ``post[e]:post[e + 1]`` of example and weight. ``column[t]`` is the
    place of a frequent term among the columns of ``full``, whose last is the common term; else -1.
    """

    term: np.ndarray
    weight: np.ndarray
    doc: np.ndarray
    toxic: np.ndarray
    column: np.ndarray
    full: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    post: np.ndarray
    example: np.ndarray
    value: np.ndarray

    @staticmethod
    def make(term: np.ndarray, weight: np.ndarray, doc: np.ndarray, toxic: np.ndarray, text: np.ndarray, own: np.ndarray, count: np.ndarray) -> Model:
        """From (text, own, count), the words of each example by their hashes."""
        n = len(doc)
        at = np.searchsorted(term, own)
        value = (1 + np.log(count)) * weight[at]
        norm = np.sqrt(np.bincount(text, value**2, n) + COMMON_WEIGHT**2)
        value = (value / norm[text]).astype(np.float32).astype(float)  # as it is sent
        often = np.bincount(at, minlength=len(term)) > FREQUENT * n
        column = np.where(often, np.cumsum(often) - 1, -1)
        full = np.zeros((-(-n // BLOCK) * BLOCK, int(often.sum()) + 1))
        dense = column[at] >= 0
        full[text[dense], column[at[dense]]] = value[dense]
        full[:n, -1] = (COMMON_WEIGHT / norm).astype(np.float32)
        at, text, value = at[~dense], text[~dense], value[~dense]
        order = np.lexsort((text, at))
        at, text, value = at[order], text[order], value[order]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] // BLOCK != text[:-1] // BLOCK)]) if len(at) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(value, new) if len(at) else value
        return Model(term, weight, doc, toxic, column, full, np.searchsorted(at[new], np.arange(len(term) + 1)), text[new] // BLOCK, most, np.append(new, len(at)), text, value)

    def packed(self) -> bytes:
        """All of it in few bytes, for the copies that every executor keeps on disk: numbers of single precision, which these are, and the smallest whole ones."""
        small = lambda x: x.astype(np.float32) if x.dtype == float else x.astype(np.min_scalar_type(int(x.max()))) if len(x) and x.min() >= 0 and x.dtype != np.uint64 else x
        sent = {f.name: getattr(self, f.name) for f in fields(self)}
        body = pickle.dumps({k: v if k == "weight" else small(v) for k, v in sent.items()}, protocol=5)
        return pickle.dumps((len(body), pa.compress(body, "zstd", asbytes=True)))

    @staticmethod
    def unpacked(sent: bytes) -> Model:
        size, body = pickle.loads(sent)
        parts = pickle.loads(pa.decompress(body, size, "zstd", asbytes=True))
        return Model(**{k: v.astype(float) if v.dtype == np.float32 else v.astype(np.int64) if v.dtype.kind in "iu" and k != "term" else v for k, v in parts.items()})

    def nearest(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(example, similarity) of the k nearest of n texts with such words, ties to the smaller place; -1 where there are fewer. Words of no example have no weight."""
        blocks, k = len(self.full) // BLOCK, min(k, len(self.doc))
        at = np.minimum(np.searchsorted(self.term, term), max(len(self.term) - 1, 0))
        known = np.flatnonzero(self.term[at] == term) if len(self.term) else np.zeros(0, np.int64)
        text, at = text[known], at[known]
        value = (1 + np.log(count[known])) * self.weight[at]
        norm = np.sqrt(np.bincount(text, value**2, n) + COMMON_WEIGHT**2)
        value /= norm[text]
        dense = self.column[at] >= 0
        asked = np.zeros((n, self.full.shape[1]))
        asked[text[dense], self.column[at[dense]]] = value[dense]
        asked[:, -1] = COMMON_WEIGHT / norm
        score = asked @ self.full.T
        score[:, len(self.doc) :] = -1
        text, at, value = text[~dense], at[~dense], value[~dense]
        entry, which = _expand(self.first[at], self.first[at + 1] - self.first[at])
        cell = text[which] * blocks + self.block[entry]
        bound = score.reshape(n, blocks, BLOCK).max(axis=2) + np.bincount(cell, value[which] * self.most[entry], n * blocks).reshape(n, blocks) + 1e-9
        seen = np.zeros((n, blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            some = np.flatnonzero(wanted.ravel()[cell])
            posting, back = _expand(self.post[entry[some]], self.post[entry[some] + 1] - self.post[entry[some]])
            back = which[some[back]]
            score.ravel()[:] += np.bincount(text[back] * score.shape[1] + self.example[posting], value[back] * self.value[posting], score.size)
            seen[wanted] = True

        start = -(-k // BLOCK) + 1
        if blocks > start:
            best = np.zeros((n, blocks), bool)
            np.put_along_axis(best, np.argpartition(-bound, start - 1, axis=1)[:, :start], True, axis=1)
            visit(best)
            sure = np.where(np.repeat(seen, BLOCK, axis=1), score, -1)
            least = -np.partition(-sure, k - 1, axis=1)[:, k - 1]
            visit(~seen & (bound >= least[:, None]))
        else:
            visit(np.ones((n, blocks), bool))
        told = np.where(np.repeat(seen, BLOCK, axis=1), np.round(score, 9), -1)
        least = -np.partition(-told, k - 1, axis=1)[:, k - 1]
        row, place = np.nonzero((told >= least[:, None]) & (told >= 0))
        near = told[row, place]
        order = np.lexsort((place, -near, row))
        row, place, near = row[order], place[order], near[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        out_place, out_near = np.full((n, k), -1), np.full((n, k), -1.0)
        out_place[row[top], rank[top]], out_near[row[top], rank[top]] = place[top], near[top]
        return out_place, out_near

    def score(self, place: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Votes of the nearest, weighed by closeness, with two of the base rate."""
        votes = np.where(place >= 0, 1 / np.maximum(1.02 - near, 0.02), 0)
        return ((votes * self.toxic[place]).sum(axis=1) + 2 * self.toxic.mean()) / (votes.sum(axis=1) + 2)


_OPENED: dict[str, Model] = {}


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES, most_postings: int = MAX_POSTINGS) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1; where rows differ, the greater); None without a labelled text.

    Rows without id or label are left out, a repeated row is one example, and a null text an empty one.
    Equal texts count once for the weights of terms.
    """
    checkpoints.ensure(docs.sparkSession)
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("same"), "text")
    schema = "doc_id long, toxic int, same long, terms array<long>, counts array<int>"

    def describe(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                text, term, count = terms(part.column(3))
                edges = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (term.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["doc_id", "toxic", "same", "terms", "counts"])

    described = texts.dropDuplicates(["doc_id", "same"]).mapInArrow(describe, schema).checkpoint()
    first = described.select("doc_id", "same", F.size("terms").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(most).toPandas()
    kept = first[first["n"].cumsum() <= most_postings]
    if kept.empty:
        return None
    ranked = docs.sparkSession.createDataFrame([(int(d), int(x), i) for i, (d, x) in enumerate(zip(kept["doc_id"], kept["same"], strict=True))], "doc_id long, same long, rank int")
    rows = described.join(F.broadcast(ranked), ["doc_id", "same"]).orderBy("rank").toArrow().combine_chunks()  # bounded by most and most_postings
    doc, toxic, same = (rows.column(c).to_numpy() for c in ("doc_id", "toxic", "same"))
    lists, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
    text = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy())
    own_term, count = lists.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()
    term, at = np.unique(own_term, return_inverse=True)
    single = np.zeros(len(doc), bool)
    single[np.unique(same, return_index=True)[1]] = True
    one = single[text]
    n1, n = float(toxic[single].sum()), float(single.sum())
    n0, df = n - n1, np.bincount(at[one], minlength=len(term)).astype(float)
    a = np.bincount(at[one], toxic[text[one]], len(term))
    b = df - a
    spread = df * (n - df) * n1 * n0
    chi = np.where((spread > 0) & (a * n0 > b * n1), n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(spread, 1), 0)
    weight = np.log((1 + n) / (1 + df)) * np.maximum(LEAST_SHARE, (chi / (chi + HALF)) ** STEEP)
    return Model.make(term, weight, doc, toxic.astype(float), text, own_term, count)


def classify(docs: DataFrame, model: Model | None, evidence: int = 3) -> DataFrame:
    """docs (text and any columns) with score and evidence (doc_id, similarity and label of the nearest examples).

    Only the text counts. Null and empty texts score as texts without any evidence; without a model
    every score is 0. Repeated rows stay; columns named as the result's are replaced.
    """
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))
    base = docs.drop("score", "evidence").withColumns({"score": F.lit(0.0), "evidence": F.array().cast("array<struct<doc_id:long,similarity:double,toxic:double>>")})
    checkpoints.ensure(docs.sparkSession)
    if model is None:
        return base
    sent, name = docs.sparkSession.sparkContext.broadcast(model.packed()), uuid.uuid4().hex

    def judge(batches):
        if name not in _OPENED:  # a worker keeps the model that it works with
            _OPENED.clear()
            _OPENED[name] = Model.unpacked(sent.value)
        own = _OPENED[name]
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                column = dict(zip(part.schema.names, part.columns, strict=True))
                for at in range(0, part.num_rows, 256):  # many short texts in a slice
                    piece = {k: v.slice(at, 256) for k, v in column.items()}
                    place, near = own.nearest(*terms(piece["text"]), len(piece["text"]))
                    top, close = place[:, :evidence], near[:, :evidence]
                    ok = top >= 0
                    told = pa.StructArray.from_arrays([pa.array(own.doc[top[ok]]), pa.array(close[ok]), pa.array(own.toxic[top[ok]])], fields=list(kind.value_type))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ok.sum(axis=1))], pa.int32()), told)
                    piece |= {"score": pa.array(own.score(place, near)), "evidence": lists.cast(kind)}
                    yield pa.RecordBatch.from_arrays(list(piece.values()), list(piece))

    return base.mapInArrow(judge, base.schema)
