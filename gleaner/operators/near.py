"""The nearest of many places for each of many points, by levels of cells with bounds.

Places lie on the unit sphere in space, where cells have no poles and no date line. Each level's cells are a fourth as wide as those above;
a cell knows the smallest box around its places and how many there are, and one with few is a leaf. A request starts at the whole and
goes down level by level: every cell is at least as far as its box's near side and its places at most as far as the far one, so as soon as
enough places are surely within some distance, cells that begin beyond it are dropped. What is left at the end are
leaves around the answer, however places crowd and however far a request is from all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numbers import haversine
from gleaner.sources.scratch import materialize

METRES = 6371008.8
#: Places of a leaf, at most, but for those that no level tells apart; and the last level, whose cells are under a metre wide.
LEAF = 32
LEVELS = 12
_XYZ = ("x", "y", "z")
#: What rounding may add to a distance between points of the unit sphere.
_SLACK = 1e-14


def on_sphere(lat: Column, lng: Column) -> list[Column]:
    lat, lng = F.radians(lat), F.radians(lng)
    return [(F.cos(lat) * F.cos(lng)).alias("x"), (F.cos(lat) * F.sin(lng)).alias("y"), F.sin(lat).alias("z")]


def _whole() -> Column:
    """The cell above those of the first level, of which there are 64 at most."""
    return F.struct(*[F.lit(0).cast("long").alias(c) for c in _XYZ])


def _there(lat: str, lng: str) -> Column:
    return F.col(lat).isNotNull() & ~F.isnan(lat) & F.col(lng).isNotNull() & ~F.isnan(lng)


def _cell(level: int) -> Column:
    """The cell of a point: its coordinates in fourths of fourths of the whole."""
    return F.struct(*[F.floor((F.col(c) + 1) * (4.0**level / 2)).alias(c) for c in _XYZ])


def levels(points: DataFrame, by: Sequence[str], leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """cells (by, level, cell, above, n, is_leaf and the box), points with the level and cell of their leaf, and the deepest level.
    points: by, x, y, z and whatever else. Only points of crowded cells go on to the next level."""
    by = list(by)
    cells, done, left = None, None, points.withColumn("_above", _whole())
    for level in range(1, LEVELS + 1):
        own = left.withColumn("cell", _cell(level))
        boxes = own.groupBy(*by, "cell", "_above").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in _XYZ for n, f in (("low", F.min), ("high", F.max))])
        boxes = materialize(boxes.select("*", F.lit(level).alias("level"), (F.lit(level == LEVELS) | (F.col("n") <= leaf)).alias("is_leaf")), "cells")
        cells = boxes if cells is None else cells.unionByName(boxes)
        told = own.join(boxes.select(*by, "cell", "is_leaf"), [*by, "cell"])
        ended = told.where("is_leaf").drop("is_leaf", "_above").withColumn("level", F.lit(level))
        done = ended if done is None else done.unionByName(ended)
        if boxes.where("not is_leaf").isEmpty():
            break
        left = materialize(told.where("not is_leaf").drop("is_leaf", "_above").withColumnRenamed("cell", "_above"), "crowded")
    return cells.withColumnRenamed("_above", "above"), done, level


def _pow2(c: Column) -> Column:
    return c * c


def candidates(requests: DataFrame, places: DataFrame, key: str, by: Sequence[str] = (), most: int = 1, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """What search looks at: pairs (spot, key, _plat, _plng, _lat, _lng, and reach if there is one), and the spot of each request."""
    by = list(by)
    reach = "reach" in requests.columns
    spot = [*by, "_lat", "_lng", *(["reach"] if reach else [])]
    asks = requests.where(_there("lat", "lng")).select("request", *by, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), *(["reach"] if reach else []))
    stock = places.where(_there("lat", "lng")).select(*by, key, F.col("lat").alias("_plat"), F.col("lng").alias("_plng"))
    if most == 1:
        stock = stock.groupBy(*by, "_plat", "_plng").agg(F.min(key).alias(key))
    else:
        first = F.row_number().over(Window.partitionBy(*by, "_plat", "_plng").orderBy(key))
        stock = stock.withColumn("_first", first).where(F.col("_first") <= most).drop("_first")
    cells, leaves, deepest = levels(materialize(stock.select("*", *on_sphere(F.col("_plat"), F.col("_plng"))), "places"), by, leaf)
    far = 2 * F.sin(F.least(F.col("reach") / (2 * METRES), F.lit(1.5707963267948966))) if reach else F.lit(2.0)
    spots = asks.select(*spot).distinct().select("*", *on_sphere(F.col("_lat"), F.col("_lng")), (far * (1 + 1e-9) + _SLACK).alias("limit"))
    spots = materialize(spots.withColumn("spot", F.monotonically_increasing_id()), "spots")
    own = ["spot", *by, *_XYZ, "limit"]
    front = spots.select(*own, _whole().alias("above"))
    near = sum((_pow2(F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0))) for c in _XYZ), F.lit(0.0))
    away = sum((_pow2(F.greatest(F.abs(F.col(f"low_{c}") - F.col(c)), F.abs(F.col(f"high_{c}") - F.col(c)))) for c in _XYZ), F.lit(0.0))
    kept = None
    for level in range(1, deepest + 1):
        below = cells.where(F.col("level") == level).select(*by, "above", "cell", "level", "n", "is_leaf", *[f"{n}_{c}" for c in _XYZ for n in ("low", "high")])
        # The first level has 64 cells at most, for each `by`.
        # The first level has 64 cells at most, for each `by`.
        met = front.join(below if by or level > 1 else F.broadcast(below), [*by, "above"])
        met = met.select(*own, "cell", "level", "n", "is_leaf", F.sqrt(near).alias("near"), F.sqrt(away).alias("away"))
        if kept is not None:
            met = met.unionByName(kept)
        if most == 1:
            sure = F.min("away").over(Window.partitionBy("spot"))
        else:
            met = met.withColumn("_sum", F.sum("n").over(Window.partitionBy("spot").orderBy("away", "near", "level", "cell").rowsBetween(Window.unboundedPreceding, 0)))
            sure = F.min(F.when(F.col("_sum") >= most, F.col("away"))).over(Window.partitionBy("spot"))
        met = met.withColumn("limit", F.least("limit", sure * (1 + 1e-9) + _SLACK)).where(F.col("near") <= F.col("limit")).drop("_sum")
        met = materialize(met, "front")
        kept = met.where("is_leaf")
        front = met.where("not is_leaf").withColumnRenamed("cell", "above").select(*own, "above")
    pairs = kept.select("spot", *by, "cell", "level").join(leaves.select(*by, "cell", "level", key, "_plat", "_plng"), [*by, "cell", "level"])
    place = ["_lat", "_lng", *(["reach"] if reach else [])]
    pairs = pairs.select("spot", key, "_plat", "_plng").join(spots.select("spot", *place), "spot")
    return pairs, asks.join(spots.select("spot", *spot), spot).select("request", "spot")


def search(requests: DataFrame, places: DataFrame, key: str, by: Sequence[str] = (), most: int = 1, leaf: int = LEAF) -> DataFrame:
    """request, rank (from 1), key and distance: the `most` nearest places of each request, of those that share its `by`, and not
    farther than its reach, if requests have a column reach (metres); nearest first, ties by key.

    requests: request, by, lat, lng; places: key, by, lat, lng. Those without coordinates take no part, and a null in `by` shares with nothing.
    Requests at one point (with one reach) are one; of places at one point the first `most` by key count. Pairs that are looked at follow the number of
    requests, not that of places times requests: see LEAF.
    """
    pairs, spots = candidates(requests, places, key, by, most, leaf)
    met = pairs.withColumn("distance", haversine(F.col("_lat"), F.col("_lng"), F.col("_plat"), F.col("_plng")))
    if "reach" in requests.columns:
        met = met.where("distance <= reach")
    rank = F.row_number().over(Window.partitionBy("spot").orderBy("distance", key))
    best = met.select("spot", key, "distance").withColumn("rank", rank).where(F.col("rank") <= most)
    return spots.join(best, "spot").select("request", "rank", key, "distance")
