from pyspark.sql import functions as F
from tarnlake.sources.partitions import Partitioned


def test_days_are_replaced_and_skipped(spark, tmp_path):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 6).cast("int"))
    rows = spark.range(600).select(F.when(F.col("id") % 7 != 6, day).alias("day"), F.col("id").alias("n"))
    mart = Partitioned(spark, f"file:{tmp_path}/mart", "day", rows.schema)
    assert mart.read().count() == 0
    mart.replace(rows)
    assert sorted(map(tuple, mart.read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    whole = lambda: spark.read.schema(mart.schema).parquet(mart.path)
    before = files(whole())
    one = files(whole().filter("day = '2024-01-03'"))
    assert one < before and all("day=2024-01-03" in f for f in one)
    assert mart.replace(rows.filter("day = '2024-01-03'").withColumn("n", -F.col("n")), ["2024-01-03", "2024-01-05", None]) == [f"file:{tmp_path}/mart/day=2024-01-05", f"file:{tmp_path}/mart/day=__HIVE_DEFAULT_PARTITION__"]
    after = files(whole())
    assert {f for f in before if "day=2024-01-03" not in f and "day=2024-01-05" not in f and "HIVE" not in f} < after
    assert mart.read().filter("day = '2024-01-05' OR day IS NULL").count() == 0 and mart.read().filter("n < 0").count() == rows.filter("day = '2024-01-03'").count()
    few = spark.createDataFrame([("2024-01-02",)], "d string").select(F.col("d").cast("date").alias("day")).filter("day > '2020-01-01'")
    met = mart.read().join(few, "day")
    assert met.count() == rows.filter("day = '2024-01-02'").count()
    assert "dynamicpruning" in met._jdf.queryExecution().toString()
