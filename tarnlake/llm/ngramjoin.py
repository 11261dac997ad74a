"""Jaccard join of documents on word shingles by token-combination prefixes.

A set of n shingles lacks at most ``slack`` = n (1 - t) of them in any set it links with. Shingles have one
global order, rare ones first, and a class by how many sets hold them: of class k, combinations of k
shingles are indexed. A class's shingles are dealt to parts; of a part with c shingles in a set's prefix,
a partner must lack c - k + 1 to share no combination. The prefix is extended until these numbers sum up
to more than the slack, so linked sets share a key. Frequent shingles thus make no long lists by
themselves, and a shingle that one set alone holds makes no key at all.

Before that, sets without partners are told from a part of the shingles, chosen by hash: whoever has
more of these to himself than the slack allows can have no link. A fifth of all shingles is looked at
first, then three tenths of those of the sets that are left. What shares a key is compared whole, as in
``jaccard``: with one of the key's sets first, then in bounded blocks.

Shingles travel with as many bits as their number asks for. Two that share these make a needless
candidate at most; links are decided by all 64 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checkpoints, jaccard
from . import words as W

#: Up to which part of all shingles, in the order of their hashes, each screening looks.
SCREENS = (0.2, 0.5)
#: Shingles of so many sets at most are of class 1, then of class 2; others are of class 3.
RARE, FREQUENT = 8, 256
#: About so many shingles of a prefix are in one part of a class.
PART = 8
#: Bits of a shingle beyond those that count all of them.
SPARE = 7


def _upto(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def _named(texts: DataFrame, size: int, screens: tuple[float, ...]) -> DataFrame:
    """texts (doc_id, k1, k2, text) to their keys, a name of the text's set, its size, and how many shingles each screening has seen of it after all before."""

    def make(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                value, bounds = jaccard.shingles(part.column(3), size)
                names = jaccard._names(value, bounds)
                short = np.frombuffer(b"".join(names), np.int64)[::2]
                below = [np.concatenate([[0], np.cumsum(value <= _upto(s))])[bounds] for s in screens]
                seen = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([np.diff(b) for b in below], axis=1).ravel()), len(screens)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(names, pa.binary()), pa.array(short), pa.array(np.diff(bounds)), seen], ["doc_id", "k1", "k2", "own", "short", "n", "seen"])

    return texts.mapInArrow(make, "doc_id long, k1 long, k2 long, own binary, short long, n long, seen array<long>")


def _linkable(n, percent: int):
    """Whether a set of n shingles (column or array) can link with a different one: its partner may have one more and lack none."""
    return (100 - percent) * n >= percent


def _screened(texts: DataFrame, size: int, percent: int, low: float, high: float, mask: int) -> DataFrame:
    """(short, token) of the shingles between two parts of all; sets that link with their equals alone have none."""

    def make(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                value, bounds = jaccard.shingles(part.column(0), size)
                short = np.frombuffer(b"".join(jaccard._names(value, bounds)), np.int64)[::2]
                n = np.diff(bounds)
                taken = (value <= _upto(high)) & ((value > _upto(low)) | (low == 0)) & np.repeat(_linkable(n, percent), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(short, n)[taken]), pa.array((value[taken] & np.uint64(mask)).view(np.int64))], ["short", "token"])

    return texts.mapInArrow(make, "short long, token long")


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def signatures(n: int, token: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set of n shingles, of which ``token`` are in ``held`` sets each and all others in this one alone."""
    need = (100 - percent) * n // 100 + 1 - (n - len(token))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((token, held))
    token, kind = token[order], 1 + (held[order] > RARE).astype(np.int64) + (held[order] > FREQUENT)
    once = np.concatenate([[True], token[1:] != token[:-1]])
    token, kind = token[once], kind[once]
    out = []
    every = kind
    # sets that may link share the level of the smaller one
    for level in range(max(1, -(-percent * n // 100)).bit_length() - 1, int(n).bit_length()):
        parts = max(1, round((1 << level) * (100 - percent) / 100 / PART))
        # combinations lose up to three shingles a part: where sets of the level have none to spare, all shingles are of class 1
        kind = every if -(-percent * (1 << level) // 100) > 3 * parts else np.ones_like(every)
        code = np.where(kind == 1, -1, kind * parts + (token % np.uint64(parts)).astype(np.int64))
        by = np.lexsort((np.arange(len(code)), code))
        first = np.concatenate([[True], code[by][1:] != code[by][:-1]])
        start = np.flatnonzero(first)
        rank = np.empty(len(code), np.int64)
        rank[by] = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        end = int(np.searchsorted(np.cumsum((kind == 1) | (rank >= kind - 1)), need)) + 1
        mark = W.mix(np.uint64(level) + np.arange(4, dtype=np.uint64) * np.uint64(1 << 32))
        out.append(W.mix(token[:end][kind[:end] == 1] + mark[1]))
        by = by[(by < end) & (code[by] >= 0)]
        cuts = np.flatnonzero(np.diff(code[by])) + 1
        for held_in in np.split(by, cuts):
            k = int(kind[held_in[0]]) if len(held_in) else 0
            if k and len(held_in) >= k:
                chosen = token[np.sort(held_in)][_choices(len(held_in), k)]
                key = np.full(len(chosen), mark[k], np.uint64)
                for i in range(k):
                    key = W.mix(key + chosen[:, i])
                out.append(key)
    return np.unique(np.concatenate(out))


def _posts(told: DataFrame, percent: int, bits: int) -> DataFrame:
    """told (id, n, packed: array of counts above ``bits`` bits of a shingle) to (own, n, key); own is the id as bytes that sort like it."""

    def make(batches):
        for batch in batches:
            number, n, lists = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            packed, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                some = packed[at[i] : at[i + 1]]
                keys = signatures(int(n[i]), (some & ((1 << bits) - 1)).view(np.uint64), some >> bits, percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([number[i].to_bytes(8, "big")] * len(keys), pa.binary()), pa.array(np.full(len(keys), n[i])), pa.array(keys.view(np.int64))], ["own", "n", "key"])

    return told.mapInArrow(make, "own binary, n long, key long")


def jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85, screens: tuple[float, ...] = SCREENS, most_sent: int = jaccard.MOST_SENT, block: int = jaccard.BLOCK) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id), one row for each row.

    Words are what is not ASCII white space, A-Z lower-cased; a text's set has its distinct shingles of
    ``size`` words, or its whole sequence where it has fewer. Two rows link where the Jaccard similarity of
    their sets is ``percent`` of a hundred or more; component_id is the smallest doc_id that links reach,
    the row's own included. Null, empty and blank texts have no shingles and no links, not even with each
    other. A row without a doc_id keeps a null; linked rows give it theirs. Rows of one doc_id are rows
    like others, repeated rows stay, other columns are ignored. No link is lost: keys are exact, up to
    equal 64-bit hashes of two shingles.
    """
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    texts = docs.select(F.col("doc_id").cast("long"), *jaccard.row_key(), F.col("text").cast("string").alias("text"))
    own = _named(texts, size, screens).checkpoint()
    sets, posts = possible(texts, own, size, percent, screens, most_sent)
    posts, _ = jaccard.in_company(posts, ["key"])
    roots = jaccard.reached(posts, ["key"], sets.select("own", "hashes"), percent, block)
    return _components(own.select("doc_id", "own", "n"), sets.select("own", "name").join(roots.withColumnRenamed("node", "own"), "own").select(F.col("name").alias("own"), "root"))


def possible(texts: DataFrame, own: DataFrame, size: int, percent: int, screens: tuple[float, ...], most_sent: int) -> tuple[DataFrame, DataFrame]:
    """texts and their names to the sets that screenings leave, (id, own, name, n, hashes), and their posts (own, n, key): different sets that link share a key."""
    bits = min(52, max(32, (own.agg(F.sum("n")).first()[0] or 0).bit_length() + SPARE))
    sets = _sets_in_company(texts, own, size, percent, screens, (1 << bits) - 1, most_sent)
    tokens = sets.select("id", "n", F.explode("hashes").alias("token")).withColumn("token", F.col("token").bitwiseAND((1 << bits) - 1))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    packed = F.shiftleft(F.least("held", F.lit((1 << 63 - bits) - 1)), bits).bitwiseOR(F.col("token"))
    told = tokens.join(held, "token").groupBy("id").agg(F.first("n").alias("n"), F.collect_list(packed).alias("packed"))
    return sets, _posts(told, percent, bits)


def _sets_in_company(texts: DataFrame, own: DataFrame, size: int, percent: int, screens: tuple[float, ...], mask: int, most_sent: int) -> DataFrame:
    """(id, own, name, n, hashes) of each set that the screenings leave a link possible; own is the id as bytes."""
    slack = F.expr(f"{100 - percent} * n div 100")
    first = lambda c: F.first(c).alias(c)
    alive = own.groupBy("own").agg(first("short"), first("n"), first("seen"), F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("copies"))
    alive = alive.filter(_linkable(F.col("n"), percent)).select("own", "short", "n", "seen", "k.k1", "k.k2", "copies", F.lit(0).cast("long").alias("met"))
    low, some = 0.0, texts
    for i, high in enumerate(screens):
        rows = _screened(some.select("text"), size, percent, low, high, mask)
        shared = rows.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token")
        hits = rows.join(shared, "token").groupBy("short").agg(F.count("*").alias("hits"))
        met = F.col("met") + F.expr("coalesce(hits, 0) div copies")  # each copy has told of the same shingles
        alive = alive.join(hits, "short", "left").withColumn("met", met).filter(F.col("met") >= F.get("seen", F.lit(i)) - slack)
        alive = alive.select("own", "short", "n", "seen", "k1", "k2", F.lit(1).alias("copies"), "met").checkpoint()
        low, some = high, jaccard._met(texts, alive, "left_semi", most_sent)
    found = jaccard._sets(some.select("text"), size).select(F.monotonically_increasing_id().alias("id"), F.col("own").alias("name"), F.size("hashes").cast("long").alias("n"), "hashes").checkpoint()
    again = found.groupBy("name").agg(F.min("id").alias("_id"), F.count("*").alias("rows")).filter("rows > 1").select("name", "_id").checkpoint()
    if not again.isEmpty():  # whole rows that are repeated
        found = found.join(again, "name", "left").filter("_id IS NULL OR id = _id").drop("_id").checkpoint()
    return found.select("id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("own"), "name", "n", "hashes")


def _components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (doc_id, own, n) and the roots of linked sets to the smallest doc_id of each component; sets and components shrink to a row before they are joined."""
    least = rows.filter("n > 0").groupBy("own").agg(F.min("doc_id").alias("least"))
    linked = roots.join(least, "own")
    of_root = linked.groupBy("root").agg(F.min("least").alias("best"))
    known = least.join(linked.join(of_root, "root").select("own", "best"), "own", "left").select("own", F.coalesce("best", "least").alias("component_id"))
    out = rows.join(known, "own", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
