"""Micro-batches that are written once, however often they are played again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table import Table

SCHEMA = "stream string, batch long, version int"


@dataclass
class Batches:
    """The batches of one stream that are done, in a table of ids.

    A batch that writes one table by ``append_once`` and then marks itself leaves nothing twice: the commit
    names its batch, and a batch that is not marked looks for itself among the commits since the last mark.
    """

    table: Table
    stream: str

    def last(self) -> tuple[int, int]:
        """The last batch that is done and its version of the table written; -1 for both before the first."""
        if not self.table.exists():
            return -1, -1
        r = self.table.read(where=F.col("stream") == self.stream).agg(F.max(F.struct("batch", "version")).alias("m")).first()["m"]
        return (r["batch"], r["version"]) if r else (-1, -1)

    def done(self, batch: int) -> bool:
        return batch <= self.last()[0]

    def append_once(self, target: Table, rows: DataFrame, batch: int, partition_by: list[str] | None = None) -> int:
        """Append the rows of a batch unless a commit has them; the version that does."""
        for c in target.commits(after=self.last()[1]):
            if c.metrics.get("stream") == self.stream and c.metrics.get("batch") == batch:
                return c.version
        return target.append(rows, partition_by, metrics={"stream": self.stream, "batch": batch}).version

    def mark(self, batch: int, version: int = -1) -> None:
        self.table.append(self.table.spark.createDataFrame([(self.stream, batch, max(version, self.last()[1]))], SCHEMA))
