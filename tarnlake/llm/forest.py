"""Small random forests: grown on the driver from a bounded table, applied as SQL expressions."""

from __future__ import annotations

import random
from collections.abc import Sequence

Tree = float | tuple[str, float, "Tree", "Tree"]


def _gini(pos: float, n: float) -> float:
    return 2 * pos * (n - pos) / n if n else 0.0


def _grow(rows: list[dict[str, float]], names: Sequence[str], rng: random.Random, depth: int, least: int) -> Tree:
    pos = sum(r["label"] for r in rows)
    if depth == 0 or len(rows) < 2 * least or pos in (0, len(rows)):
        return round((pos + 1) / (len(rows) + 2), 6)
    best = None
    for name in rng.sample(list(names), max(1, round(len(names) ** 0.5))):
        ordered = sorted(rows, key=lambda r: r[name])
        left = 0.0
        for i in range(1, len(ordered)):
            left += ordered[i - 1]["label"]
            low, high = ordered[i - 1][name], ordered[i][name]
            if low == high or i < least or len(ordered) - i < least:
                continue
            impure = _gini(left, i) + _gini(pos - left, len(ordered) - i)
            if best is None or impure < best[0]:
                best = impure, name, round((low + high) / 2, 6)
    if best is None:
        return round((pos + 1) / (len(rows) + 2), 6)
    _, name, cut = best
    sides = [r for r in rows if r[name] <= cut], [r for r in rows if r[name] > cut]
    return name, cut, *(_grow(s, names, rng, depth - 1, least) for s in sides)


def grow(rows: list[dict[str, float]], names: Sequence[str], trees: int = 15, depth: int = 5, least: int = 4, seed: int = 1) -> list[Tree]:
    """Trees on bootstrap samples, each split among a random few of the features. rows have a label of 0 or 1."""
    rng = random.Random(seed)
    return [_grow(rng.choices(rows, k=len(rows)), names, rng, depth, least) for _ in range(trees)]


def _case(tree: Tree, prefix: str) -> str:
    if not isinstance(tree, tuple):
        return repr(float(tree))
    name, cut, low, high = tree
    return f"CASE WHEN {prefix}{name} <= {float(cut)!r} THEN {_case(low, prefix)} ELSE {_case(high, prefix)} END"


def sql(trees: list[Tree], prefix: str = "") -> str:
    """The mean vote as a SQL expression over the features' names. Its literals are doubles in any dialect."""
    votes = " + ".join(f"CAST({_case(t, prefix)} AS DOUBLE)" for t in trees)
    return f"({votes}) / {len(trees)}"


def predict(trees: list[Tree], row: dict[str, float]) -> float:
    def vote(t: Tree) -> float:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    return sum(map(vote, trees)) / len(trees)
