"""Matching of labels with reference lists, by equality or by substring, and by lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import contains_either, js_trim
from gleaner.operators.containment import containing
from gleaner.sources.scratch import materialize

MOST_MENU, MOST_POPULAR = 60, 20


def reference_list(menu: Column, popular: Column) -> Column:
    """The first items of the menu, or, without one, of the popular names."""
    menu, popular = F.coalesce(menu, F.array().cast("array<string>")), F.coalesce(popular, F.array().cast("array<string>"))
    return F.when(F.size(menu) > 0, F.slice(menu, 1, MOST_MENU)).otherwise(F.slice(popular, 1, MOST_POPULAR))


def first_equal(text: Column, items: Column) -> Column:
    """The first item that equals the text but for case and white space around it, as it is written in the list; else null."""
    return F.get(F.filter(items, lambda x: js_trim(F.lower(x)) == F.lower(text)), F.lit(0))


def first_index(text: Column, items: Column) -> Column:
    """The index of the first item that holds the text or is held by it, from 0; -1 if none does."""
    return F.coalesce(F.array_position(F.transform(items, lambda x: contains_either(x, text)), True).cast("int") - 1, F.lit(-1))


def match(rows: DataFrame, text: str, items: str) -> DataFrame:
    """rows with name (the matched item, else the text) and is_match."""
    found = first_equal(F.col(text), F.col(items))
    return rows.withColumn("name", F.coalesce(found, F.col(text))).withColumn("is_match", F.coalesce(F.length(found) > 0, F.lit(False)))


def match_table(rows: DataFrame, items: DataFrame, key: str, text: str = "text", item: str = "item", order: str = "ord") -> DataFrame:
    """As match, where each key's items are rows of a table: one row for each key and normal form goes into an equi-join."""
    normal = lambda c: js_trim(F.lower(c))
    firsts = items.groupBy(key, normal(F.col(item)).alias("_normal")).agg(F.min_by(item, order).alias("_item"))
    out = rows.withColumn("_normal", F.lower(text)).join(firsts, [key, "_normal"], "left")
    return out.withColumn("name", F.coalesce("_item", text)).withColumn("is_match", F.coalesce(F.length("_item") > 0, F.lit(False))).drop("_normal", "_item")


def first_containing(names: DataFrame, listed: DataFrame, key: str, text: str = "text", item: str = "item", order: str = "ord") -> DataFrame:
    """names with idx, as first_index of the list of their key, where each key's items are rows of a table: the least order of an item that
    holds the text or is held by it, whatever their case; -1 if there is none.

    Distinct texts and items meet by grams, in both directions (see containment), so a key with very many names or items is no cross product. An empty
    text is held by every item and an empty item by every text of its key, as in SQL. A null text, or a null key, has -1.
    """
    low = names.select(key, F.lower(text).alias("_text")).where("_text is not null").distinct()
    items = materialize(listed.where(F.col(item).isNotNull()).groupBy(key, F.lower(item).alias("_item")).agg(F.min(order).alias("_idx")), "items")
    as_ = lambda df, column, name: df.select(key, F.col(column).alias(name))
    held = containing(as_(low, "_text", "needle"), as_(items, "_item", "hay"), [key]).select(key, F.col("needle").alias("_text"), F.col("hay").alias("_item"))
    holds = containing(as_(items, "_item", "needle"), as_(low, "_text", "hay"), [key]).select(key, F.col("hay").alias("_text"), F.col("needle").alias("_item"))
    met = held.union(holds).join(items, [key, "_item"]).groupBy(key, "_text").agg(F.min("_idx").alias("_idx"))
    # Empty ones meet the least item of their key, without pairs.
    least = lambda where: items.where(where).groupBy(key).agg(F.min("_idx").alias("_idx"))
    empty = low.where("_text = ''").join(least("true"), key).unionByName(low.join(least("_item = ''"), key))
    best = met.unionByName(empty.select(key, "_text", "_idx")).groupBy(key, "_text").agg(F.min("_idx").alias("_idx"))
    out = names.withColumn("_text", F.lower(text)).join(best, [key, "_text"], "left")
    return out.select(*names.columns, F.coalesce("_idx", F.lit(-1)).alias("idx"))


def in_lexicon(rows: DataFrame, column: str, words: tuple[str, ...], keep: bool = True) -> DataFrame:
    """The rows whose column is one of the words, or with keep=False, those of which it is not; a list of fixed size needs no join."""
    is_in = F.coalesce(F.col(column).isin(*words), F.lit(False))
    return rows.where(is_in if keep else ~is_in)


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of some parts, by their own case."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))
