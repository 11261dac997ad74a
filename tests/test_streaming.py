from pyspark.sql import functions as F
from tarnlake.sources.table import Table
from tarnlake.streaming import events as streams


def test_merge_twice_inserts_once(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(20).withColumn("ts", F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(0, cast(id AS int)) ")).repartition(4).write.parquet(src)
    for _ in range(2):
        streams.merge_stream(spark, src, str(tmp_path / "t"), str(tmp_path / "c"), ["id"])
    streams.merge_stream(spark, src, str(tmp_path / "t"), str(tmp_path / "other"), ["id"])
    assert Table(spark, str(tmp_path / "t")).read().count() == 20


def test_stream_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, cast(id AS int))")).alias("event_time"), F.lit("view").alias("event_type"), F.col("id").cast("string").alias("event_key"), (F.col("id") % 3).alias("user_id"))
    rows.coalesce(1).write.parquet(src)
    stream = streams.source(spark, src)
    for name, made, batch in (("days", streams.daily_counts(stream), streams.daily_counts(rows)), ("sess", streams.session_windows(stream), streams.session_windows(rows))):
        q = made.writeStream.format("memory").queryName(name).outputMode("complete" if name == "days" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
        if name == "days":
            assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))
        else:
            assert 0 < spark.table(name).count() <= batch.count()
    twice = streams.deduplicated(streams.source(spark, src).union(streams.source(spark, src)))
    q = twice.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 200
