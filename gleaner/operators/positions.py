"""Positions of rows in an order, and joins of tables by position, without a sort of all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.scratch import materialize

#: monotonically_increasing_id has the partition above these bits, and the row in its partition below them.
_ROW_BITS = 33


def positions(rows: DataFrame, order: Sequence[str | Column], key: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """rows with name, their position from 0 in the order, or within each key; nulls first unless the order says otherwise.

    Rows are dealt by ranges of key and order, so that a key with very many rows goes over many tasks; each task numbers its own, and what
    lies before a range is a sum over as many counts as there are ranges. Rows that the order does not tell apart get positions in any
    order, and keep them: the numbered rows are written to the shared folder. A null key is a key as any other. No rows give none.
    """
    by = [F.col(k).asc_nulls_first() for k in key] + [c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]
    own = [c for c in rows.columns if c != name]
    sorted_ = rows.select(own).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "positions")
    numbered = numbered.withColumn("_range", F.shiftrightunsigned("_at", _ROW_BITS))
    counts = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range: the number of shuffle partitions bounds this table.
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_before")
    placed = numbered.join(F.broadcast(offsets), "_range").withColumn(name, at)
    if not key:
        return placed.select(*own, name)
    firsts = placed.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)]).agg(F.min(name).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(key)]
    return placed.join(firsts, same).select(*own, (F.col(name) - F.col("_first")).alias(name))


def zip_tables(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column], key: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Each row of left with the row of right at its position (within its key), as two lists are zipped. how: left keeps what right is too
    short for; inner and full as of a join. The result has key, pos, left's columns and right's; a column of both is taken from left."""
    own = [c for c in left.columns if c not in key]
    others = [c for c in right.columns if c not in key and c not in own]
    a = positions(left, left_order, key)
    b = positions(right, right_order, key).select(*[F.col(k).alias(f"_right_{k}") for k in key], F.col("pos").alias("_right_pos"), *others)
    same = (F.col("pos") == F.col("_right_pos"))
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    out = a.join(b, same, how)
    return out.select(*[F.coalesce(k, f"_right_{k}").alias(k) for k in key], F.coalesce("pos", "_right_pos").alias("pos"), *own, *others)
