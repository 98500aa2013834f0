"""Debouncing of events and the first event of each key, over tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, first_at, fires_at (gap after the last event) and n of each run of events at most gap apart, as session windows merge them; a table or a stream with a watermark."""
    runs = events.groupBy(key, F.session_window(F.col(time), gap).alias("run")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("run.start").alias("first_at"), F.col("run.end").alias("fires_at"), "n")


def debounced_stream(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """As debounced, for a stream: a run is given once the watermark passes its end. Times without a zone are taken as UTC."""
    stream = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return debounced(stream, key, time, gap)


def first_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key. The limit works before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_events_stream(events: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first event of each key to arrive. With a time, a key is forgotten once the watermark, late behind the latest event, has passed its
    first event, so the state is bounded by the keys of that span: a later event then counts as a first one. Without, every key is kept."""
    if time is None:
        return events.dropDuplicates([key])
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def fresh(events: DataFrame, time: str, now, seconds: int = 60) -> DataFrame:
    """Events at most so many seconds old."""
    return events.where(F.col(time) >= F.lit(now) - F.expr(f"interval {seconds} seconds"))
