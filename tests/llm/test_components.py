"""Rounds of connected components: what they return, and what they leave behind."""

import pathlib
import random

from tarnlake.llm.components import connected_components


def slow(edges):
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    return root


def test_rounds_keep_no_estimates(spark):
    """The optimizer's estimates were multiplied from round to round, to numbers of megabytes in the driver."""
    rng = random.Random(1)
    names = rng.sample(range(1000), 200)
    edges = [*zip(names, names[1:], strict=False), *((rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(120)), (5000, 5000)]
    found = connected_components(spark.createDataFrame([*edges, edges[0], (None, 1)], "a long, b long"))
    estimate = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert estimate < 1 << 63
    assert {r["node"]: r["root"] for r in found.collect()} == slow(edges)


def test_steps_are_removed(spark):
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("steps-*"))
    edges = [(bytes([i]), bytes([i + 1])) for i in range(30)]
    found = connected_components(spark.createDataFrame(edges, "a binary, b binary"))
    assert set(folder.glob("steps-*")) == before
    assert {bytes(r["node"]): bytes(r["root"]) for r in found.collect()} == slow(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert [tuple(r) for r in connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect()] == [(3, 3)]
