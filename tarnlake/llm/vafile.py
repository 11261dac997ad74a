"""Exact top-k inner products with vector-approximation files.

A table of its own holds one byte for each component, the cell of a grid. Scanning it gives bounds of all
scores: a task keeps, for each query, the rows that its k best lower bounds leave possible, and the k-th
lower bound over all tasks then drops most of these. Exact vectors are read by id, for each query in the
order of its upper bounds, a growing number at a time, until no bound reaches the k-th score found.

Queries go in batches of bounded size. Of equal vectors only the k + 1 smallest ids can matter, and of an
id's repeated rows k, so a vector that a third of all rows hold costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checkpoints

CELLS = 256
#: Queries in a pass: a bounded broadcast.
QUERIES = 4096
#: Rows of the approximation that are bounded at once, by so many queries.
BLOCK, ASKED = 4096, 512
#: Ids whose vectors are asked for by a broadcast; beyond, by a shuffle.
MOST_SENT = 500_000


def quantised(scale: int) -> Column:
    """Integer components; null where the vector is null or holds a null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def _columns(lists: pa.Array, here: np.ndarray, n: int) -> np.ndarray:
    """Rows ``here`` of a list column, each of n values, as a matrix."""
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    return flat[starts[here][:, None] + np.arange(n)] if n else np.zeros((len(here), 0), np.int64)


class Grid:
    """Where the cells of vectors of one length begin, and how wide they are."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low = low.astype(np.float64)
        self.width = np.maximum(1, np.ceil((high - self.low + 1) / cells))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower bounds of queries x rows, what is added to a query's for the upper ones): each component at the worse and better end of its cell.

        The product is in single precision; what it may be off by is taken from one and added to the other.
        """
        q = queries.astype(np.float64)
        steep = q * self.width
        # a sum of n products of magnitude at most 255 |steep| is off by less than (n + 2) 2**-23 of their sum
        off = (cells.shape[1] + 2) * 2.0**-23 * CELLS * np.abs(steep).sum(axis=1) + 2.0**-40 * np.abs(q @ self.low)
        least = (np.minimum(q, 0) * (self.width - 1)).sum(axis=1) - off - 1
        most = (np.maximum(q, 0) * (self.width - 1)).sum(axis=1) + off + 1
        base = (steep.astype(np.float32) @ cells.T.astype(np.float32)).astype(np.float64)
        return base + (q @ self.low + least)[:, None], most - least


class _Best:
    """A task's possible rows for each of some queries: those whose upper bound reaches the k-th lower bound seen so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.least = np.full(len(ids), -np.inf)
        self.rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
        self.held = np.zeros(len(ids), np.int64)

    def add(self, at: int, vec: np.ndarray, lower: np.ndarray, more: np.ndarray) -> None:
        for i in np.flatnonzero((lower + more[:, None] >= self.least[at : at + len(lower), None]).any(axis=1)).tolist():
            q = at + i
            ok = np.flatnonzero((lower[i] + more[i] >= self.least[q]) & (vec != self.ids[q]))
            self.rows[q].append((vec[ok], lower[i, ok]))
            self.held[q] += len(ok)
            if self.held[q] > 4 * self.k:
                self.prune(q, more[i])

    def prune(self, q: int, more: float) -> None:
        vec, low = (np.concatenate([r[i] for r in self.rows[q]]) for i in (0, 1))
        if len(low) >= self.k:
            self.least[q] = max(self.least[q], -np.partition(-low, self.k - 1)[self.k - 1])
        ok = low + more >= self.least[q]
        self.rows[q] = [(vec[ok], low[ok])]
        self.held[q] = int(ok.sum())


def _grids(rows: DataFrame) -> dict[int, Grid]:
    """The grid of each length, from minima and maxima that tasks and then the cluster reduce."""

    def extent(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                values = _columns(lists, np.flatnonzero(sizes == n), n)
                low[n] = np.minimum(low.get(n, values.min(axis=0)), values.min(axis=0))
                high[n] = np.maximum(high.get(n, values.max(axis=0)), values.max(axis=0))
        for n in low:
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(n, n)), "place": pa.array(np.arange(n)), "low": pa.array(low[n], pa.int64()), "high": pa.array(high[n], pa.int64())})

    found = rows.select("v").mapInArrow(extent, "n long, place long, low long, high long").groupBy("n", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, Grid] = {}
    table = found.orderBy("n", "place").toPandas()  # a row for each component of each length
    for n, part in table.groupby("n"):
        low, high = part["low"].to_numpy(), part["high"].to_numpy()
        if n * float(max(abs(low).max(), abs(high).max())) ** 2 >= 2**63:
            raise ValueError(f"scores of vectors of length {n} may not fit into 64 bits")
        out[int(n)] = Grid(low, high)
    return out


def _without_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows without those of a vector's copies that k + 1 smaller ids stand before, or k rows of the same id: a query's own id takes one of these ids away, and all of its rows."""
    marked = rows.withColumns({"_a": F.xxhash64("v"), "_b": F.xxhash64(F.lit(k), "v")})
    hot = marked.groupBy("_a", "_b").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("_a", "_b").checkpoint()
    n = hot.count()
    if not n:
        return rows
    held = marked.join(F.broadcast(hot) if n <= MOST_SENT else hot, ["_a", "_b"], "left_semi")
    ids = held.groupBy("_a", "_b", "vec_id").agg(F.first("v").alias("v"), F.least(F.count("*"), F.lit(k)).alias("_rows"))
    first = ids.withColumn("_rank", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("vec_id"))).filter(F.col("_rank") <= k + 1)
    first = first.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    rest = marked.join(F.broadcast(hot) if n <= MOST_SENT else hot, ["_a", "_b"], "left_anti")
    return rest.select("vec_id", "v").unionByName(first.select("vec_id", "v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, batch: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries against all rows of vectors but those of its own id.

    Both tables have vec_id and embedding. A component x counts as floor(scale * x), a score is an
    integer inner product of vectors of the same length; where it may not fit into 64 bits, that is an
    error. Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; a vector without components scores 0. Repeated rows are candidates each; query rows of one id
    and vector are one query, and another vector of that id is a query of its own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    checkpoints.ensure(spark)
    tidy = lambda t: t.select(F.col("vec_id").cast("long"), quantised(scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows, asked = _without_copies(tidy(vectors), k), tidy(queries).distinct().checkpoint()
    grids = _grids(tidy(vectors).unionByName(asked))  # a length of no row has no grid and no candidate
    grid = spark.sparkContext.broadcast(grids)

    def approximate(batches):
        for part in batches:
            lists = part.column(1)
            sizes = lists.value_lengths().to_numpy()
            out = [b""] * part.num_rows
            for n in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == n)
                cells = grid.value[n].cells(_columns(lists, here, n)) if n else np.zeros((len(here), 0), np.uint8)
                for i, row in zip(here.tolist(), cells, strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "n", "cells"])

    cells = rows.mapInArrow(approximate, "vec_id long, n int, cells binary").checkpoint()  # the approximation file
    passes = max(1, -(-asked.count() // batch))
    out = None
    for p in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p) if passes > 1 else asked
        groups: dict[int, tuple[list, list]] = {}
        for r in own.orderBy("vec_id", "v").toLocalIterator():
            ids, values = groups.setdefault(len(r["v"]), ([], []))
            ids.append(r["vec_id"])
            values.append(r["v"])
        found = _search(rows, cells, {n: (np.array(i), np.array(v, np.int64).reshape(len(i), n)) for n, (i, v) in groups.items()}, grids, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, cells: DataFrame, groups: dict[int, tuple[np.ndarray, np.ndarray]], grids: dict[int, Grid], k: int) -> DataFrame:
    """The k best rows for the queries of a pass, (ids, vectors) by length."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((groups, {n: grids[n] for n in groups if n}))
    first, total = {}, 0  # a query's number in this pass
    for n in groups:
        first[n], total = total, total + len(groups[n][0])

    def scan(batches):
        asked, grid = sent.value
        best = {n: _Best(ids, k) for n, (ids, _) in asked.items()}
        more = {n: np.zeros(len(ids)) for n, (ids, _) in asked.items()}
        for part in batches:
            for at in range(0, part.num_rows, BLOCK):
                piece = part.slice(at, BLOCK)
                ids, sizes, raw = piece.column(0).to_numpy(), piece.column(1).to_numpy(), piece.column(2)
                for n, (query_ids, values) in asked.items():
                    here = np.flatnonzero(sizes == n)
                    if not len(here):
                        continue
                    held = np.frombuffer(b"".join(raw.take(pa.array(here)).to_pylist()), np.uint8).reshape(len(here), n)
                    for j in range(0, len(query_ids), ASKED):
                        lower, more[n][j : j + ASKED] = grid[n].bounds(held, values[j : j + ASKED]) if n else (np.zeros((len(query_ids[j : j + ASKED]), len(here))), 0)
                        best[n].add(j, ids[here], lower, more[n][j : j + ASKED])
        for n, own in best.items():
            for q in np.flatnonzero(own.held).tolist():
                own.prune(q, more[n][q])
                vec, low = own.rows[q][0]
                yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(vec), first[n] + q)), "vec_id": pa.array(vec), "low": pa.array(low), "high": pa.array(low + more[n][q])})

    possible = cells.mapInArrow(scan, "query long, vec_id long, low double, high double").checkpoint()
    kth = possible.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"), "vec_id"))).filter(F.col("_rank") == k).select("query", F.col("low").alias("least"))
    live = possible.join(F.broadcast(kth), "query", "left").filter("least IS NULL OR high >= least").groupBy("query", "vec_id").agg(F.max("high").alias("high")).checkpoint()

    def score(batches):
        asked, _ = sent.value
        for part in batches:
            number, vec, lists = part.column(0).to_numpy(), part.column(1), part.column(2)
            sizes, out = lists.value_lengths().to_numpy(), np.zeros(part.num_rows, np.int64)
            for n, (_, values) in asked.items():
                here = np.flatnonzero((number >= first[n]) & (number < first[n] + len(values)))
                here = here[sizes[here] == n]
                out[here] = (_columns(lists, here, n) * values[number[here] - first[n]]).sum(axis=1)
            same = np.zeros(part.num_rows, bool)
            for n in asked:
                same |= (number >= first[n]) & (number < first[n] + len(asked[n][0])) & (sizes == n)
            yield pa.RecordBatch.from_arrays([part.column(0), vec, pa.array(out)], ["query", "vec_id", "score"]).filter(pa.array(same))

    take, ranked = 4 * k, Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query long, vec_id long, score long")
    while not live.isEmpty():  # a query's next rows in the order of their bounds
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "vec_id"))
        placed = live.withColumn("_at", order).checkpoint()
        wanted = placed.filter(F.col("_at") <= take).select("query", "vec_id")
        ids = wanted.select("vec_id").distinct()
        read = rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "vec_id", "left_semi")
        exact = wanted.join(read, "vec_id").select("query", "vec_id", "v").mapInArrow(score, "query long, vec_id long, score long")
        best = best.unionByName(exact).withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).select("query", "vec_id", "score").checkpoint()
        sure = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).select("query", "kth")
        left = placed.filter(F.col("_at") > take).select("query", "vec_id", "high")
        live = left.join(F.broadcast(sure), "query", "left").filter("kth IS NULL OR high >= kth").select("query", "vec_id", "high").checkpoint()
        take *= 4
    names = spark.createDataFrame([(first[n] + i, int(q)) for n, (ids, _) in groups.items() for i, q in enumerate(ids.tolist())], "query long, query_id long")
    return best.withColumn("rank", F.row_number().over(ranked)).join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")
