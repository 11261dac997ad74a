"""Whitening against a dense eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest

from tarnlake.llm import whitening


def _expected(vectors, components=16):
    """vec_id's rows from fractions: the covariance in whole numbers, eigenvectors by LAPACK."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    centred = np.array([[n * x[j] - sums[j] for j in range(dim)] for x in fit], object)
    covariance = (centred.T @ centred).astype(float) / n**3
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(sum(sum(int(d) ** 2 for d in row) for row in centred)) / n**3
    out = {}
    for i, x in kept:
        y = [n * x[j] - sums[j] for j in range(dim)]
        out[i, tuple(x)] = (sum(d * d for d in y), (np.array(y, float) / n) @ axes / np.sqrt(values))
    return n, values / trace, out


def _check(spark, vectors, components=16):
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = whitening.whiten(docs, components).collect()
    n, explained, want = _expected(vectors, components)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    for (i, _), (deviation, white) in want.items():
        own = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, len(white) + 1))
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)
        assert np.allclose(np.abs([r["whitened"] for r in own]), np.abs(white), atol=1e-7)
        assert {r["identity_error"] for r in own} == {found[0]["identity_error"]} and own[0]["identity_error"] < 1e-9
    assert len(found) == sum(len(w) for _, w in want.values())
    # one sign for all rows
    for c in range(1, min(components, len(explained)) + 1):
        sign = {np.sign(r["whitened"] * want[i, x][1][c - 1]) for (i, x) in want for r in by[i] if r["component"] == c and abs(r["whitened"]) > 1e-6}
        assert len(sign) == 1


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    values = rng.standard_normal((300, 24)) * np.linspace(3, 0.2, 24) + 5
    _check(spark, [(i, v) for i, v in enumerate(values.tolist())])


def test_nulls_repeats_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    values = (rng.standard_normal((60, 5)) * [4, 3, 2, 1.5, 1]).tolist()
    rows = [(i, v) for i, v in enumerate(values)] + [(100 + i, values[0]) for i in range(200)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    _check(spark, rows)
    _check(spark, rows, 3)


def test_few_vectors_lengths_and_no_rows(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert make([]) == []
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector: nothing varies
    found = make([(1, [1.0, 2.0, 0.0]), (2, [3.0, 5.0, 0.0]), (3, []), (None, [7.0]), (5, [9.0])])
    assert sorted((str(r["vec_id"]), r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in found) == [("1", 1, 2, 1.0), ("2", 1, 2, 1.0), ("5", 1, 2, 1.0), ("None", 1, 2, 1.0)]
    with pytest.raises(Exception, match="beyond"):
        make([(1, [1e300])])


def test_lanczos_restarts_where_eigenvalues_repeat():
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for values in (np.repeat([5.0, 5.0, 2.0, 1.0], 10), np.r_[np.full(12, 3.0), np.zeros(28)], np.ones(40), np.r_[1e6, np.linspace(1, 2, 39)]):
        matrix = axes * values @ axes.T
        found, vectors, passes = whitening.lanczos(lambda b, m=matrix: m @ b, 40, 16, block=3)
        assert np.allclose(found, np.sort(values)[::-1][:16], atol=1e-8 * values.max())
        assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-10)
        assert np.linalg.norm(matrix @ vectors - vectors * found) < 1e-8 * values.max()
        assert passes <= 3


def test_lanczos_ends_early_where_residuals_allow():
    rng = np.random.default_rng(7)
    axes = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = np.r_[2.0 ** -np.arange(20), np.full(380, 1e-9)]
    matrix = axes * values @ axes.T
    found, _, passes = whitening.lanczos(lambda b: matrix @ b, 400, 8, tolerance=1e-12)
    assert passes < 10 and np.allclose(found, values[:8], rtol=1e-9)
