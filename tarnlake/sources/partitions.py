"""Marts in Spark's own partitions: a folder for each value, replaced whole.

For marts whose key holds the partition and which others read by plain Spark. A run replaces the folders
of the values that it has made anew and touches no other; readers skip folders by their names, also by a
join's values at run time. There are no versions: readers of a folder that is being replaced may fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: The folder of null values; a fixed value.
NONE = "__HIVE_DEFAULT_PARTITION__"


class Partitioned:
    def __init__(self, spark: SparkSession, path: str, by: str, schema: T.StructType):
        self.spark, self.path, self.by, self.schema = spark, path.rstrip("/"), by, schema

    def read(self) -> DataFrame:
        fs, p = store.at(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def replace(self, rows: DataFrame, values: list | None = None) -> list[str]:
        """Put rows in the place of the partitions that they are in, and empty those of ``values`` without a row; returns the latter's folders. A few files for each value, however many rows share one."""
        out = rows.select(*self.schema.names).repartition(F.col(self.by), F.pmod(F.xxhash64(*[c for c in self.schema.names if c != self.by]), F.lit(4)))
        out.write.partitionBy(self.by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        gone = []
        if values:
            kind = self.schema[self.by].dataType
            asked = self.spark.createDataFrame([(None if v is None else str(v),) for v in values], "v string").select(F.col("v").cast(kind).alias(self.by)).distinct()
            there = rows.select(F.col(self.by).alias("_there")).distinct()
            for r in asked.join(there, asked[self.by].eqNullSafe(there["_there"]), "left_anti").select(F.col(self.by).cast("string")).collect():
                folder = f"{self.path}/{self.by}={NONE if r[0] is None else r[0]}"
                fs, p = store.at(self.spark, folder)
                if fs.exists(p):
                    fs.delete(p, True)
                    gone.append(folder)
        return gone
