"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed: a pass over the distinct vectors multiplies it with a block of a few
vectors, each task by its rows, centred first, and the sums come back as one small matrix. A new block is
orthogonalised against all earlier ones, twice; directions that vanish are replaced by random ones that
are orthogonal to the rest, so equal or zero eigenvalues don't end the search. It ends when the residuals
of the wanted eigenpairs are at rounding level, or when the blocks span the whole space. The trace comes
from the exact deviations, not from eigenvalues.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checkpoints

SCALE, SHIFT = 64, 1_000_000
#: Vectors of one pass.
BLOCK = 16
#: Residual norms, as a share of the greatest eigenvalue, at which a pair has converged.
TOLERANCE = 1e-14
SEED = 17
#: An eigenvalue below this share of the greatest one is zero but for rounding: there is nothing to whiten.
ZERO = 1e-13
#: Entries beyond this would not fit into 64 bits as integers.
MOST = 2.0**50


def integers(column: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where a vector is null or holds a null or non-finite entry."""
    v = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.when(F.exists(v, lambda x: F.abs(x) > MOST), F.raise_error("an entry is beyond 2**50")).cast("string").isNull()
    return F.when(~bad & large, F.transform(v, lambda x: F.floor(x * SCALE).cast("long") + SHIFT))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), dim)


class Centre:
    """n vectors of one length, and their sums: what centres others exactly."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.n * float(max(abs(x).max(initial=0), 1)) + float(abs(self.sums).max(initial=0)) >= 2**62:
            raise ValueError("n times an entry does not fit into 64 bits")
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.times_n(x) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        y = self.times_n(x)
        if float(abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) >= 2**63:
            raise ValueError("a deviation does not fit into 64 bits")
        return (y * y).sum(axis=1)


def _summed(fit: DataFrame, dim: int, shape: tuple[int, int], of) -> np.ndarray:
    """The sum over all batches of ``of(x)``, a matrix of this shape: each task's first, then by entry."""

    def make(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += of(_matrix(batch.column(0), dim))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())})

    parts = fit.select("x").mapInArrow(make, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[parts["at"].to_numpy()] = parts["value"].to_numpy()
    return out.reshape(shape)


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for those of block, orthogonal to basis; where one vanishes, the search restarts from a random direction."""
    out = basis
    for v in block.T:
        if out.shape[1] == basis.shape[0]:
            break
        size = np.linalg.norm(v)
        for attempt in range(4):
            w = v / size if size else v
            for _ in range(2):
                w = w - out @ (out.T @ w)
            left = np.linalg.norm(w)
            if left > 1e-10:
                break
            v = rng.standard_normal(len(v))
            size = np.linalg.norm(v)
        w = w / left
        w = w - out @ (out.T @ w)
        out = np.column_stack([out, w / np.linalg.norm(w)])
    return out[:, basis.shape[1] :]


def lanczos(multiply, dim: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` greatest eigenvalues and their vectors (columns) of a symmetric matrix, and the number of passes; ``multiply`` gives its product with a block.

    A block has ``wanted`` vectors at least: fewer would find an eigenvalue that is repeated more often only in part.
    """
    block = min(dim, max(block, wanted, 1))
    rng = np.random.default_rng(SEED)
    basis = products = np.zeros((dim, 0))
    fresh = _orthogonal(rng.standard_normal((dim, block)), basis, rng)
    passes = 0
    while True:
        more = multiply(fresh)
        passes += 1
        basis, products = np.column_stack([basis, fresh]), np.column_stack([products, more])
        small = basis.T @ products
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        ritz = basis @ vectors
        off = np.linalg.norm(products @ vectors - ritz * values, axis=0)
        done = basis.shape[1] >= dim or (len(values) == min(wanted, dim) and off.max(initial=0) <= tolerance * max(abs(values[0]), np.finfo(float).tiny))
        if done:
            return values, ritz / np.linalg.norm(ritz, axis=0), passes
        fresh = _orthogonal(more - basis @ (basis.T @ more), basis, rng)


def whiten(vectors: DataFrame, components: int = 16, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) to (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out. The fit list holds each
    distinct integer vector once, so repeated rows weigh nothing, but get their rows. Vectors of another
    length are a fit list of their own; vectors without entries have no rows. There are fewer components
    where the vectors have fewer dimensions or fewer eigenvalues above zero, none where all are equal.
    Null ids stay, other columns are ignored. Entries beyond 2**50 and sums beyond 64 bits are errors.
    """
    spark = vectors.sparkSession
    checkpoints.ensure(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    fit = rows.select("x").distinct().checkpoint()
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dim, n in sorted(tuple(r) for r in fit.groupBy(F.size("x")).count().collect()):
        out = out.unionByName(_whitened(rows.filter(F.size("x") == dim), fit.filter(F.size("x") == dim), dim, n, components, block))
    return out


def _whitened(rows: DataFrame, fit: DataFrame, dim: int, n: int, components: int, block: int) -> DataFrame:
    def entries(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if abs(x).max(initial=0) * float(len(x)) >= 2**62:
                raise ValueError("sums do not fit into 64 bits")
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim)), "value": pa.array(x.sum(axis=0))})

    sums = np.zeros(dim, np.int64)
    parts = fit.mapInArrow(entries, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    sums[parts["at"].to_numpy()] = parts["value"].to_numpy()
    centre = Centre(n, sums)

    def deviations(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"d": pa.array(centre.deviations(_matrix(batch.column(0), dim)))})

    total = fit.mapInArrow(deviations, "d long").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
    trace = float(total / n / n / n) if total else 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x)
            return y.T @ (y @ block)

        return _summed(fit, dim, block.shape, of) / n

    values, axes = np.zeros(0), np.zeros((dim, 0))
    if trace > 0:
        values, axes, _ = lanczos(multiply, dim, min(components, dim), block)
        real = values > ZERO * values[0]
        values, axes = values[real], axes[:, real]
    scaled = axes / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x) @ scaled
        return np.vstack([z.sum(axis=0), z.T @ z])

    found = _summed(fit, dim, (k + 1, k), moments) / n if k else np.zeros((1, 0))
    error = float(abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max(initial=0))
    explained = values / trace if k else values

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            z, m = centre.centred(x) @ scaled, len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(centre.deviations(x), k)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
