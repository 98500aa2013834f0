"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.scratch import drop, materialize, settled, shared_dir

__all__ = ["WORD", "apart", "drop", "materialize", "partitions", "pick", "read", "set_aside", "settled", "shared_dir", "small_batches", "text_bytes", "without"]

#: A word of every operator here: a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch of texts, where the session has Spark's own larger bound.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for Python workers, two of which may share a small executor; a bound that was set lower stays."""
    if not spark.conf.isModifiable(_BATCH):
        return
    digits = "".join(c for c in spark.conf.get(_BATCH) if c.isdigit() or c == "-")
    if not 0 < int(digits or 0) <= BATCH_BYTES or spark.conf.get(_BATCH).rstrip("bB") != digits:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns of those names (in any case) under others, and what selects df's columns from a result, by their own names again."""
    own = {c: f"__gleaner_own_{c}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(own), lambda out: out.select([F.col(own.get(c, c)).alias(c) for c in df.columns])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of those names: the one of that very name, else one that differs in case only, whatever other columns are called."""
    at = {n: n if n in df.columns else next(c for c in df.columns if c.lower() == n.lower()) for n in names}
    plain = df.toDF(*[f"__gleaner_at_{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"__gleaner_at_{df.columns.index(at[n])}").alias(n) for n in names])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of those names, whatever their case: what an operator adds under a name replaces them."""
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in {n.lower() for n in names}]
    if len(kept) == len(df.columns):
        return df
    plain = df.toDF(*[f"__gleaner_at_{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"__gleaner_at_{i}").alias(df.columns[i]) for i in kept])


def apart(df: DataFrame, needed: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with the needed columns by their names and all others under names of no one else, and what makes a result of it: the kept columns
    by their own names, in their order, then new ones, by name or as Columns. Columns of replaced names, in any case, are not kept. A needed column is the one
    of that very name, else one that differs in case only."""
    at = {n: df.columns.index(n) if n in df.columns else next(i for i, c in enumerate(df.columns) if c.lower() == n.lower()) for n in needed}
    names = [f"__gleaner_at_{i}" for i in range(len(df.columns))]
    for n, i in at.items():
        names[i] = n
    gone = {r.lower() for r in replaced}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in gone]

    def back(out: DataFrame, *new: str, **made: Column) -> DataFrame:
        own = [F.col(names[i]).alias(df.columns[i]) for i in kept]
        return out.select(*own, *[F.col(n).alias(n.rsplit(".", 1)[-1]) for n in new], *[c.alias(n) for n, c in made.items()])

    return df.toDF(*names), back


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
