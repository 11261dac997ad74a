"""Near-duplicates by the exact Jaccard similarity of distinct word shingles, met through prefixes and SimHash.

Sets that link share a key of ``ngramjoin``'s prefixes, so no link is lost; sets without such a partner are told
before. Those left whose SimHash fingerprints differ in at most RADIUS bits, or are joined by such, meet through the
byte-position index of ``simhash`` with its count filter too. The exact similarity decides on all that meet, so a link
is never wrong. Equal sets are one node.

A large group of near copies never becomes all of its pairs. Each key's sets are first compared with one
of them, that which has most company, and linked to it. All sets that were compared with the same one are
a pool. Only sets that are not yet in the component of their pool's most are then compared with the
others, and of these with no more than the metric allows: two sets whose distances from the same third
one differ by more than the greatest distance of a link can't be linked. They meet in blocks of bounded
size, two at a time, and each pair of blocks returns a forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checkpoints, simhash
from . import words as W
from .components import connected_components

#: Kinds of keys by prefixes; the next kind is that of fingerprints.
BANDS = 1
SEED = 31
#: Bits in which fingerprints of sets that meet may differ.
RADIUS = 3
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
#: Row keys that are sent to all workers; beyond, the texts are shuffled to them.
MOST_SENT = 500_000
#: Hashes, and 128 for each set, of which two such parts are compared at a time.
BLOCK = 1 << 17
#: Whatever is not ASCII white space, with A-Z lower-cased.
FOLDED = W.Alphabet(lambda b: not (b == 32 or 9 <= b <= 13), W._lower)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the texts' bounds among them. A text of fewer words is one shingle."""
    found = W.split(column, FOLDED)
    counts, first = found.counts(), found.bounds[:-1]
    text, value = [], []
    for k in range(1, size + 1):
        grams = W.grams(found.hash, k)
        if k == size:
            at = np.flatnonzero(W.fits(found.bounds, len(grams), k))
            owner = np.searchsorted(found.bounds, at, "right") - 1
        else:
            owner = np.flatnonzero(counts == k)
            at = first[owner]
        text.append(owner)
        value.append(grams[at])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(column) + 1))


def _names(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for i, mask in enumerate((0, 0x5851F42D4C957F2D)):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(W.mix(value ^ np.uint64(mask)), out=total[1:])
        out[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    return [row.tobytes() for row in out]


def _fingerprints(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if set in over half of the hashes."""
    total = np.zeros((len(bounds) - 1, 64), np.int64)
    for at in range(0, len(value), COUNTED):
        some = value[at : at + COUNTED]
        first = np.clip(bounds - at, 0, len(some))
        here = np.flatnonzero(np.diff(first))
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[here] += np.add.reduceat(bits, first[here], axis=0, dtype=np.int64)
    return np.packbits(2 * total > np.diff(bounds)[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """sets (own, n, bits) to (own, n, band, key), one row for each: key names what links of RADIUS bits reach."""
    prints = sets.select("bits").distinct().withColumn("node", F.col("bits")).select("node", "bits").checkpoint()
    roots = connected_components(simhash.links(prints, RADIUS)).withColumnRenamed("node", "bits")
    return sets.join(roots, "bits", "left").select("own", "n", F.lit(BANDS).alias("band"), F.coalesce("root", "bits").alias("key"))


def _printed(sets: DataFrame) -> DataFrame:
    """sets (own, hashes) with their number and fingerprint."""

    def make(batches):
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            value = lists.values.to_numpy()[bounds[0] : bounds[-1]].view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(_fingerprints(value, bounds - bounds[0]))], ["own", "n", "bits"])

    return sets.select("own", "hashes").mapInArrow(make, "own binary, n long, bits long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                value, bounds = shingles(part.column(0), size)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(value, bounds), pa.binary()), sets], ["own", "hashes"])

    return docs.mapInArrow(make, "own binary, hashes array<long>")


def row_key() -> list[Column]:
    """128 bits of a row's doc_id and text."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text").cast("string")]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(SEED), *parts).alias("k2")]


def _met(rows: DataFrame, keys: DataFrame, how: str, most: int) -> DataFrame:
    """Semi or anti join by k1 and k2. A few keys are sent to all workers by their first half, which is a plain number, and the second half is compared there; of more, both sides are shuffled."""
    k = keys.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    if k.count() <= most:
        return rows.join(F.broadcast(k), (rows["k1"] == k["_k1"]) & ~(rows["k2"] != k["_k2"]), how)
    return rows.join(k, (rows["k1"] == k["_k1"]) & (rows["k2"] == k["_k2"]), how)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, most_sent: int = MOST_SENT, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) to (doc_id, k1, k2, group), one row for each row: its key, and a name of its group.

    Two texts link where the Jaccard similarity of their sets is ``percent`` of a hundred or more; a group
    is all that links reach. Texts without words, null ones too, are equal. Rows are told apart by doc_id
    and text: two texts of one doc_id may be in two groups. Null ids are ids like others. Repeated rows
    stay, other columns are ignored. No link is lost, up to equal 64-bit hashes of two shingles.
    """
    from . import ngramjoin  # it builds on this module

    checkpoints.ensure(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), *row_key(), F.col("text").cast("string").alias("text"))
    own = ngramjoin._named(texts, size, ngramjoin.SCREENS).checkpoint()
    sets, posts = ngramjoin.possible(texts, own, size, percent, ngramjoin.SCREENS, most_sent)
    prints = _printed(sets).checkpoint()
    posts, _ = in_company(posts.withColumn("band", F.lit(0)).unionByName(by_fingerprint(prints)), ["band", "key"])
    roots = reached(posts, ["band", "key"], sets.select("own", "hashes"), percent, block)
    named = sets.select("own", "name").join(roots.withColumnRenamed("node", "own"), "own").select(F.col("name").alias("own"), "root")
    return own.join(named, "own", "left").select("doc_id", "k1", "k2", F.coalesce("root", "own").alias("group"))


def in_company(posts: DataFrame, bucket: list[str]) -> tuple[DataFrame, DataFrame]:
    """posts (own, n and the bucket's columns) without buckets of one row, and (own, weight): how many rows each set meets."""
    shared = posts.groupBy(*bucket).agg(F.count("*").alias("company")).filter("company > 1")
    posts = posts.join(shared, bucket).checkpoint()
    return posts, posts.groupBy("own").agg(F.sum("company").alias("weight")).checkpoint()


def reached(posts: DataFrame, bucket: list[str], sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """posts in company and their sets (own, hashes) to (node, root) of all sets that a link joins to another.

    Two sets link where they share a bucket and their Jaccard similarity is ``percent`` of a hundred or more.
    """
    company = posts.groupBy("own").agg(F.sum("company").alias("weight"))
    middle = posts.join(company, "own").groupBy(*bucket).agg(F.max_by(F.struct("own", "n"), F.struct("weight", "own")).alias("c"))
    starred = posts.join(middle, bucket).select("own", "n", F.col("c.own").alias("c")).distinct().checkpoint()
    first = _compared(starred.filter("own <> c").select(F.least("own", "c").alias("a"), F.greatest("own", "c").alias("b")).distinct(), sets, percent).checkpoint()
    roots = connected_components(first.filter("linked").select("a", "b"))
    named = starred.join(roots.withColumnRenamed("node", "own"), "own", "left").withColumns({"label": F.coalesce("root", "own"), "a": F.least("own", "c"), "b": F.greatest("own", "c")})
    far = F.coalesce(F.col("distance"), F.lit(0.0)).alias("far")
    classes = named.groupBy("c", "label").agg(F.count("*").alias("rows")).groupBy("c").agg(F.max_by("label", F.struct("rows", "label")).alias("most"), F.count("*").alias("labels"), F.sum("rows").alias("all"))
    # the two sets of a pool of two were compared
    open_ = named.join(classes.filter("labels > 1 AND all > 2"), "c").join(first, ["a", "b"], "left").select("c", "own", "n", "label", "most", far).checkpoint()
    second = _met_in_blocks(open_, sets, percent, block).checkpoint()
    if second.isEmpty():
        return roots
    return connected_components(first.filter("linked").select("a", "b").unionByName(second))


def _met_in_blocks(open_: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """open_ (c, own, n, label, most, far) to links (a, b) that join its labels as all links between them would.

    Sets outside the most frequent label of their c meet the sets whose distance from c a link allows. Both
    sides are dealt to parts of about ``size`` hashes; two parts at a time meet in a task, which returns no more
    links than it has sets.
    """
    reach = 1 - percent / 100 + 1e-9
    step = F.floor(F.col("far") / reach).cast("int")
    rows = open_.withColumn("step", step)
    ring = ["c", "step"]
    left = rows.filter("label <> most").withColumn("step", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)))
    parts = lambda side, name: side.groupBy(*ring).agg(F.ceil(F.sum(F.col("n") + 128) / size).cast("int").alias(name))
    sizes = parts(left, "lefts").join(parts(rows, "rights"), ring).checkpoint()
    part = lambda count: F.pmod(F.xxhash64("own"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    hashes = sets.select("own", "hashes")
    block = [*ring, "i", "j"]
    kept = lambda name: [F.col(c).alias(f"{name}_{c}") for c in (*block, "own", "label", "hashes")]
    left = left.join(sizes, ring).withColumn("i", part("lefts")).join(hashes, "own").withColumn("j", every("rights")).select(*kept("x"))
    right = rows.join(sizes, ring).withColumn("j", part("rights")).join(hashes, "own").withColumn("i", every("lefts")).select(*kept("y"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = _forest(x, y, percent) if len(x) and len(y) else ([], [])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    left, right = (side.groupBy(*[f"{name}_{c}" for c in block]) for side, name in ((left, "x"), (right, "y")))
    return left.cogroup(right).applyInArrow(meet, "a binary, b binary").distinct()


def _shared(x: pa.ChunkedArray, y: pa.ChunkedArray, width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many hashes each set of x shares with each of y, and the sets' sizes; by products of 0-1 matrices, ``width`` hashes at a time."""
    x, y = x.combine_chunks(), y.combine_chunks()
    p, q = (v.flatten().to_numpy() for v in (x, y))
    n, m = (np.diff(v.offsets.to_numpy()) for v in (x, y))
    names = np.intersect1d(p, q)
    out = np.zeros((len(n), len(m)), np.float64)
    owners = [np.repeat(np.arange(len(k)), k) for k in (n, m)]
    for k in range(0, len(names), width):
        some = names[k : k + width]
        sides = []
        for value, owner, count in ((p, owners[0], len(n)), (q, owners[1], len(m))):
            at = np.minimum(np.searchsorted(some, value), len(some) - 1)
            here = some[at] == value
            side = np.zeros((count, len(some)), np.float32)
            side[owner[here], at[here]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out, n, m


def _forest(x: pa.Table, y: pa.Table, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Links between sets of x and y of different labels, without those that others imply: each set with the first set of what it reaches here."""
    both, n, m = _shared(x["x_hashes"], y["y_hashes"])
    linked = 100 * both >= percent * (n[:, None] + m[None, :] - both)
    names = np.array([*x["x_own"].to_pylist(), *y["y_own"].to_pylist()], object)
    labels = np.unique(np.array([*x["x_label"].to_pylist(), *y["y_label"].to_pylist()], object), return_inverse=True)[1]
    linked &= labels[: len(n), None] != labels[None, len(n) :]
    none = len(names)
    root = np.arange(none)
    while True:
        low = root.copy()
        low[len(n) :] = np.minimum(low[len(n) :], np.where(linked, low[: len(n), None], none).min(0))
        low[: len(n)] = np.minimum(low[: len(n)], np.where(linked, low[None, len(n) :], none).min(1))
        if np.array_equal(low, root):
            break
        root = low
    moved = np.flatnonzero((root < np.arange(none)) & (names[root] != names))
    return list(names[root[moved]]), list(names[moved])


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked and the Jaccard distance, from the whole sets."""

    def compare(batches):
        for batch in batches:
            linked, distance = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                linked.append(100 * both >= percent * union)
                distance.append(1 - both / union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], ["a", "b", "linked", "distance"])

    a_sets, b_sets = (sets.select(F.col("own").alias(s), F.col("hashes").alias(f"{s}_hashes")) for s in "ab")
    return pairs.join(a_sets, "a").join(b_sets, "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(compare, "a binary, b binary, linked boolean, distance double")


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, most_sent: int = MOST_SENT) -> DataFrame:
    """Whole rows of docs (doc_id, text and any columns), of each group one: that with the least doc_id (null last), then the least key; of rows alike in both, the least by its other columns."""
    found = near_duplicates(docs, size, percent, most_sent).checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = found.groupBy("group").agg(F.min(order).alias("best"), F.count("*").alias("rows")).filter("rows > 1").select("group", "best.k1", "best.k2").checkpoint()
    keys = found.join(best.select("group", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), "group")
    keeper = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    told = keys.groupBy("k1", "k2").agg(F.bool_or(keeper).alias("keeper"), F.count("*").alias("n")).checkpoint()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    kept, again = _met(rows, told.filter("NOT keeper"), "left_anti", most_sent), told.filter("keeper AND n > 1")
    if again.isEmpty():
        return kept.select("row.*")
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*plain))
    one = _met(kept, again, "left_semi", most_sent).withColumn("place", first).filter("place = 1")
    return _met(kept, again, "left_anti", most_sent).select("row.*").unionByName(one.select("row.*"))
