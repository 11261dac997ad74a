"""What the operators need of a session: the shared folder in which lineage is cut, and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 1 << 20


def ensure(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir as the session names it.

    Every operator calls this first. Where the setting is missing, a session of this machine alone gets
    a temporary folder; on a cluster that is an error, as executors could not read it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # rows alone don't bound a batch of texts
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote between its steps."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Steps:
    """Tables of an iteration, written to the shared folder and read again, so that their size is that of their files.

    A checkpoint passes on what the optimizer took its plan's size for, the product of the sizes of all that was
    joined. Each join of a table with itself doubles that number's digits; after some rounds they fill the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{ensure(spark)}/steps-{uuid.uuid4().hex}", 0

    def keep(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        rows.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{self.n}")

    def remove(self) -> None:
        remove(self.spark, self.folder)
