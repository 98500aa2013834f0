import time

from pyspark.sql import functions as F

from gleaner.streaming import sessions


def events(spark):
    rows = [("a", 0.0), ("a", 0.2), ("a", 0.4), ("a", 1.0), ("b", 0.1), ("a", 60.0), ("b", 90.0)]
    return spark.createDataFrame(rows, "key string, s double").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


def test_debounce_fires_after_the_last_event(spark):
    got = sessions.debounced(events(spark), "key", "ts", "350 milliseconds").collect()
    found = sorted((r["key"], r["n"], F and r["fires_at"].timestamp() % 3600) for r in got)
    assert [(k, n) for k, n, _ in found] == [("a", 1), ("a", 1), ("a", 3), ("b", 1), ("b", 1)]
    assert any(abs(t - 0.75) < 1e-6 for k, n, t in found if n == 3)


def test_first_event(spark):
    got = sessions.first_events(events(spark), "key", ["ts"]).collect()
    assert {r["key"]: round(r["ts"].timestamp() % 3600, 1) for r in got} == {"a": 0.0, "b": 0.1}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    """All runs but those that the watermark has not passed."""
    source = str(tmp_path / "in")
    events(spark).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = sessions.debounced_stream(stream, "key", "ts", "350 milliseconds", "1 second").writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    time.sleep(0)
    streamed = {(r["key"], r["n"]) for r in spark.table("runs").collect()}
    assert ("a", 3) in streamed and ("b", 1) in streamed
    first = sessions.first_events_stream(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "key")
    query = first.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("firsts").count() == 2
    bounded = sessions.first_events_stream(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "key", "ts", "1 minute")
    query = bounded.writeStream.format("memory").queryName("bounded").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("bounded").count() == 2


def test_fresh(spark):
    import datetime

    now = datetime.datetime(1970, 1, 1, 0, 1, 10, tzinfo=datetime.timezone.utc)
    assert sessions.fresh(events(spark), "ts", now).count() == 2
