"""Connected components of an edge table, in rounds of joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checkpoints

#: Rows of a round's tables that one file takes; tables of few rows are not spread over all of a shuffle's partitions.
FILE_ROWS = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b; of one type that sorts) to (node, root): root is the smallest node that node reaches.

    Every round hooks each component's root below the smallest root beside it and then shortens
    the paths; all steps are joins and minima with partial aggregation, so hot nodes stay split.
    Null ends, loops and repeated edges do no harm. Each round's tables are stored, and removed after the next one.
    """
    steps = checkpoints.Steps(edges.sparkSession)
    links = steps.keep(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = links.count() // FILE_ROWS + 1
    label = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    live = links.filter("a < b")
    label = steps.keep(label.coalesce(parts))
    while not live.isEmpty():
        before, steps = steps, checkpoints.Steps(edges.sparkSession)
        # live edges join roots; the greater root of each edge hangs below the least root next to it
        hooks = live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("lower"))
        parent = _shorten(steps.keep(hooks.coalesce(parts)), parts, steps)
        label = steps.keep(_renamed(label, "root", parent).coalesce(parts))
        live = steps.keep(_renamed(_renamed(live, "a", parent), "b", parent).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(parts))
        before.remove()
    label = label.checkpoint()
    steps.remove()
    return label


def _renamed(rows: DataFrame, name: str, parent: DataFrame) -> DataFrame:
    return rows.join(parent.withColumnRenamed("root", name), name, "left").withColumn(name, F.coalesce("lower", name)).drop("lower")


def _shorten(parent: DataFrame, parts: int, steps: checkpoints.Steps) -> DataFrame:
    """Follow (root, lower) to the end of each path; lower < root, so there are no cycles. Paths halve each time."""
    while True:
        step = parent.select(F.col("root").alias("lower"), F.col("lower").alias("next"))
        further = steps.keep(parent.join(step, "lower", "left").select("root", F.coalesce("next", "lower").alias("lower"), F.col("next").isNotNull().alias("moved")).coalesce(parts))
        if further.filter("moved").isEmpty():
            return parent
        parent = further.drop("moved")
