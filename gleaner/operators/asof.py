"""As-of joins: for each row the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(requests: DataFrame, fixes: DataFrame, key: str, time: str, seconds: int, order: str, value: list[str]) -> DataFrame:
    """requests with fix_at and the value columns of the last fix of their key at their time or up to `seconds` before it; null if there is none.

    Of fixes at one time the one with the largest order counts. Each key's time is cut into spans of `seconds`, a fix is sent to its own
    span and the next, and each span is one ordered merge of both tables: a key with very many rows goes over as many tasks as it has spans, and
    there are no pairs. Rows with a null key or time have no fix, and are none.
    """
    at = lambda df: F.unix_micros(df[time].cast("timestamp"))
    wide = seconds * 1_000_000
    span = F.floor(F.col("_at") / wide)
    asked = requests.withColumn("_at", at(requests)).withColumn("_span", span)
    given = fixes.withColumn("_at", at(fixes)).where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    given = given.select(F.col(key).alias("_key"), "_at", F.struct(F.col("_at").alias("at"), F.col(time).alias("fix_at"), *[F.col(v).alias(v) for v in value]).alias("_fix"), F.col(order).alias("_order"), F.explode(F.array(span, span + 1)).alias("_span"))
    own = F.struct(*[F.col(c).alias(c) for c in requests.columns]).alias("_own")
    both = asked.select(F.col(key).alias("_key"), "_at", "_span", own, F.lit(1).alias("_side")).unionByName(given.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    merge = Window.partitionBy("_key", "_span").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_last", F.last("_fix", ignorenulls=True).over(merge)).where("_side = 1")
    fresh = F.when((F.col("_at") - F.col("_last.at") <= wide) & F.col("_key").isNotNull(), F.col("_last"))
    told = told.select("_own.*", fresh.alias("_last"))
    return told.select(*requests.columns, F.col("_last.fix_at").alias("fix_at"), *[F.col(f"_last.{v}").alias(v) for v in value])
