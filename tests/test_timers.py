"""Streams with timers: runs are given by the clock, and equal those of the table."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import sessions, timers


@pytest.fixture
def store(spark):
    settings = dict([timers.STORE, ("spark.sql.shuffle.partitions", "1")])
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark, some):
    return spark.createDataFrame(some, "key string, s double").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


def until(spark, table, n, seconds=120):
    ends = time.time() + seconds
    while time.time() < ends and spark.table(table).count() < n:
        time.sleep(0.5)


def test_runs_fire_without_another_event(spark, store, tmp_path):
    source = str(tmp_path / "in")
    table = rows(spark, [("a", 0.0), ("a", 0.2), ("a", 0.4), ("a", 1.0), ("b", 0.1), ("a", 60.0), ("b", 90.0), ("c", 0.35), ("c", 0.0), ("d", 0.349), ("d", 0.0)])
    table.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    want = sorted(map(tuple, sessions.debounced(table, "key", "ts", "350 milliseconds").select("key", "first_at", "fires_at", "n").collect()))
    query = timers.debounced_at_once(stream, "key", "ts").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until(spark, "fired", len(want))
        # The last run of each key came by its timer alone.
        assert sorted(map(tuple, spark.table("fired").select("key", "first_at", "fires_at", "n").collect())) == want
    finally:
        query.stop()


def test_first_events_come_at_once(spark, store, tmp_path):
    source = str(tmp_path / "in")
    table = rows(spark, [("a", 0.5), ("a", 0.2), ("b", 90.0), ("b", 0.1)])
    table.coalesce(1).write.parquet(source)
    first = timers.first_events_at_once(spark.readStream.schema(table.schema).parquet(source), "key", "ts")
    query = first.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    try:
        until(spark, "seen", 2)
        assert {(r["key"], r["ts"].timestamp()) for r in spark.table("seen").collect()} == {("a", 0.2), ("b", 0.1)}
    finally:
        query.stop()
