"""Nearest places by bounds, against brute force, and how many pairs are looked at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import near, places


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * near.METRES * math.asin(math.sqrt(min(1.0, x)))


def crowded(draw, n):
    """Most places in one city, the others anywhere, some at one point, at the poles and at the date line."""
    spots = [(48.0 + draw.gauss(0, 0.03), 179.99 + draw.gauss(0, 0.03)) for _ in range(n)]
    spots = [(a, b - 360 if b > 180 else b) for a, b in spots]
    spots += [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(n // 10)]
    return [(i, a, b) for i, (a, b) in enumerate([*spots, (90.0, 0.0), (90.0, 50.0), (-90.0, 1.0), *[(10.0, 20.0)] * 50, (None, 1.0), (float("nan"), 2.0)])]


@pytest.mark.parametrize("most,leaf", [(1, 32), (1, 2), (5, 16), (70, 8)])
def test_nearest_equal_brute_force(spark, most, leaf):
    draw = random.Random(most)
    stock = crowded(draw, 600)
    asked = [(i, a + 0.01, b) for i, a, b in draw.sample(stock[:-2], 60)] + [(1000, 10.0, 20.0), (1001, 10.0, 20.0), (1002, None, 3.0), (1003, -48.0, -0.01), (1004, 0.0, 0.0)]
    got = near.search(spark.createDataFrame(asked, "request int, lat double, lng double"), spark.createDataFrame(stock, "id int, lat double, lng double"), "id", most=most, leaf=leaf).collect()
    by = {}
    for r in got:
        by.setdefault(r["request"], []).append((r["rank"], r["distance"], r["id"]))
    good = [p for p in stock if p[1] is not None and not math.isnan(p[1])]
    for i, a, b in asked:
        if a is None:
            assert i not in by
            continue
        want = sorted((metres(a, b, c, d), k) for k, c, d in good)[:most]
        mine = sorted(by[i])
        assert [x[0] for x in mine] == list(range(1, len(want) + 1))
        assert [x[1] for x in mine] == pytest.approx([w[0] for w in want], abs=1e-3)
        if most == 1 and want[0][0] > 1:
            assert mine[0][2] == want[0][1]


def test_far_requests_look_at_few_places_of_a_crowd(spark):
    draw = random.Random(9)
    n, asks = 20_000, 400
    stock = spark.createDataFrame([(i, 48.0 + draw.gauss(0, 0.05), 11.0 + draw.gauss(0, 0.05)) for i in range(n)], "id int, lat double, lng double")
    asked = spark.createDataFrame([(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(asks)], "request int, lat double, lng double")
    pairs, _ = near.candidates(asked, stock, "id")
    # Two leaves a request on average, where all pairs would be 20,000 a request.
    assert pairs.count() <= asks * near.LEAF * 8
    crowd = spark.createDataFrame([(i, 48.0 + draw.gauss(0, 0.05), 11.0 + draw.gauss(0, 0.05)) for i in range(asks)], "request int, lat double, lng double")
    assert near.candidates(crowd, stock, "id")[0].count() <= asks * near.LEAF * 8


def test_views_find_the_nearest_within_their_radius(spark):
    draw = random.Random(4)
    stock = [(i, a, b, draw.choice(["restaurant", "restaurant", "bar", None])) for i, a, b in crowded(draw, 500)]
    views = [(i, a, b, draw.choice([None, 8, 10, 12, 14, 16])) for i, a, b, _ in draw.sample(stock, 50)]
    got = places.within_each(spark.createDataFrame(views, "request int, lat double, lng double, zoom int"), spark.createDataFrame(stock, "id int, lat double, lng double, kind string"), "id", kind="restaurant", leaf=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["request"], []).append((r["rank"], r["distance"]))
    for i, a, b, zoom in views:
        if a is None or math.isnan(a):
            assert i not in by
            continue
        reach = max(300, min(50000, math.floor(40000 / 2 ** ((14 if zoom is None else zoom) - 10) + 0.5)))
        want = sorted(d for k, c, e, kind in stock if kind == "restaurant" and c is not None and not math.isnan(c) for d in [metres(a, b, c, e)] if d <= reach)[:20]
        assert [x[1] for x in sorted(by.get(i, []))] == pytest.approx(want, abs=1e-3)


def test_no_places_and_no_requests(spark):
    none = spark.createDataFrame([], "id int, lat double, lng double")
    one = spark.createDataFrame([(1, 2.0, 3.0)], "request int, lat double, lng double")
    assert places.nearest_each(one, none, "id").collect() == [(1, None, None)]
    assert places.nearest_each(one.limit(0), none.unionByName(one.withColumnRenamed("request", "id")), "id").count() == 0
    assert places.within_each(one.withColumn("zoom", F.lit(3)), none, "id").count() == 0
