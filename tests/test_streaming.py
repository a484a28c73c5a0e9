"""Streams against their batch twins."""

from pyspark.sql import functions as F

from vectorloom.streaming import metrics

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def events(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)
    return spark.range(500).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), (F.col("id") % 11).cast("double").alias("value"))


def streamed(spark, df, tmp_path, mode):
    path = f"file://{tmp_path}"
    out = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    out.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def test_windows(spark, tmp_path):
    events(spark).write.parquet(f"file://{tmp_path}/in")
    metrics.closing(events(spark)).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    got = {(r.start, r.event_type): (r.n, r.mean) for r in streamed(spark, metrics.windowed_metrics(stream), tmp_path, "append").collect()}
    want = {(r.start, r.event_type): (r.n, r.mean) for r in metrics.windowed_metrics(events(spark)).collect()}
    assert got == want


def test_token_buckets(spark, tmp_path):
    events(spark).repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    got = {(r.user_id, r.ts): r.allowed for r in streamed(spark, metrics.token_bucket(stream, 1 / 1000, 2.0), tmp_path, "append").collect()}
    from vectorloom.operators import routing

    want = {(r.user_id, r.ts): r.allowed for r in routing.token_bucket(events(spark), "user_id", "ts", 1 / 1000, 2.0).collect()}
    assert got == want and {True, False} == set(got.values())
