"""Candidates, scores, ranks, owners and display buckets of media items, set-wise over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.matching import first_index

MOST_CANDIDATES = 20
#: Base scores.
BOTH, MATCHED, POPULAR, NAMED, UNNAMED, NOT_FOOD = 100, 50, 30, 10, 5, -1


def candidates(items: DataFrame, place: str, portrait: Column, order: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """The first items of each place, with candidate (from 1): upright ones after the others, else in order.

    The limit works before the shuffle, so a place with very many items sends no more than `most` from each task.
    """
    rank = F.row_number().over(Window.partitionBy(place).orderBy(portrait, *order))
    return items.withColumn("candidate", rank).where(F.col("candidate") <= most)


def priority(name: Column, is_match: Column, is_food: Column, popular: Column) -> Column:
    """-1 if it is no food; 5 without a name; else by whether it matches the menu and whether, and how high, it is popular."""
    index = first_index(name, popular)
    bonus = F.greatest(F.lit(0), F.lit(8) - index)
    return (
        F.when(~is_food, NOT_FOOD)
        .when(name.isNull() | (name == ""), UNNAMED)
        .when(is_match & (index >= 0), BOTH + bonus)
        .when(is_match, MATCHED)
        .when(index >= 0, POPULAR + bonus)
        .otherwise(NAMED)
    )


def rank(scored: DataFrame, place: str, source: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """scored (with score and candidate) without negative scores, with position (from 0) and id, best first; ties by candidate."""
    position = F.row_number().over(Window.partitionBy(place).orderBy(F.desc("score"), "candidate")) - 1
    out = scored.where("score >= 0").withColumn("position", position).where(F.col("position") < most)
    return out.withColumn("id", F.concat(F.lit(source + "-"), F.col(place).cast("string"), F.lit("-"), F.col("position").cast("string")))


def attribution(links: Column) -> Column:
    """owner or user, from an item's attribution links. The three fragments."""
    text = F.lower(F.array_join(links, " "))
    owner = F.contains(text, F.lit("owner")) | F.contains(text, F.lit("the official")) | (~F.contains(text, F.lit("maps.google.com/maps/contrib")) & (F.length(text) > 0))
    return F.when(owner, "owner").otherwise("user")


def display_url(base: str, reference: Column, width: int) -> Column:
    """The address of an item at a width; a key, if one is needed, is added by whoever fetches it, and is never in the data."""
    return F.concat(F.lit(f"{base}?maxwidth={width}&photo_reference="), reference)


def bucket(is_match: Column, name: Column) -> Column:
    """0: matches the menu; 1: has a name; 2: has none."""
    return F.when(is_match, 0).when(F.length(name) > 0, 1).otherwise(2)


def zip_names(urls: Column, names: Column) -> Column:
    """Each URL with the name at its place among the non-empty names; those move up over gaps, and a URL without one has null."""
    kept = F.filter(names, lambda x: F.length(x) > 0)
    return F.transform(urls, lambda u, i: F.struct(i.alias("pos"), u.alias("url"), F.get(kept, i).alias("name"), F.when(i == 0, "owner").otherwise("user").alias("attribution"), F.lit(600).alias("width"), F.lit(400).alias("height")))


def stats_visible(rating: Column, price: Column, is_open: Column) -> Column:
    return rating.isNotNull() | F.coalesce(price > 0, F.lit(False)) | is_open.isNotNull()


def stats_visible_sheet(rating: Column, price: Column) -> Column:
    return rating.isNotNull() | price.isNotNull()
