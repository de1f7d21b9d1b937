"""Streams give what batches give, but for windows still open."""

from pyspark.sql import functions as F

from sparkloom.streaming import operators as ops

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, build, name):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    query = build(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_tumbling_windows(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: ops.windowed(ops.timed(s, "0 seconds"), "1 hour"), "tumbling")
    batch = ops.windowed(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    want, found = {tuple(r) for r in batch.collect()}, {tuple(r) for r in got.collect()}
    assert found <= want and len(want - found) <= 10


def test_first_seen(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: ops.first_seen(s, ["user_id", "event_type"], "100 days"), "seen")
    batch = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct()
    assert got.count() == batch.count()


def test_token_bucket_refills(spark):
    rows = [(k, 1, f"2024-01-01 00:00:0{k}") for k in range(4)] + [(9, 1, "2024-01-01 03:00:00")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {r.event_id: r.passed for r in ops.token_bucket(events, 2.0, 1 / 3600).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False, 9: True}
