import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import labels, places
from gleaner.sources import readers

ANSWER = "fetched boolean, answers array<struct<status: int, text: string>>, items array<string>"


def test_cascade(spark):
    cases = [
        (True, [(200, "Ramen\nmore")], ["ramen "], ("ramen ", True, True)),
        (True, [(200, "Gyoza")], ["Ramen"], ("Gyoza", False, True)),
        (True, [(200, "NULL")], ["Ramen"], (None, False, False)),
        (True, [(200, "")], ["Ramen"], (None, False, False)),
        (False, [(200, "Ramen")], ["Ramen"], (None, False, True)),
        (True, [(403, None), (200, "Ramen")], ["Ramen"], (None, False, True)),
        (True, [(500, None), (None, None)], ["Ramen"], (None, False, True)),
        (True, [(429, None), (200, "Ramen")], ["Ramen"], ("Ramen", True, True)),
        (True, [], None, (None, False, True)),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], f"i int, {ANSWER}")
    got = labels.interpret(rows).orderBy("i").collect()
    assert [(r["name"], r["is_match"], r["is_food"]) for r in got] == [c[3] for c in cases]


def test_model_is_handed_in(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fetched", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("answers", labels.ANSWERS)])

    def model(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fetched": True, "items": [["Soup"]] * len(pdf), "answers": [[{"status": 200, "text": "soup"}]] * len(pdf)})

    got = labels.label(spark.range(5), model, schema, parallel=2).collect()
    assert {(r["name"], r["is_match"]) for r in got} == {("Soup", True)}


def test_prompt_names_the_list(spark):
    row = spark.createDataFrame([("P", ["a"], [], ["a"])], "p string, m array<string>, q array<string>, i array<string>")
    text = row.select(labels.prompt(F.col("p"), F.col("m"), F.col("q"), F.col("i")).alias("x")).first()["x"]
    assert "Menu:\n1. a" in text


def test_recorded_responses(spark, tmp_path):
    place = {"place_id": "x", "name": "N", "vicinity": "V", "geometry": {"location": {"lat": 1.0, "lng": 2.0}}, "rating": 4.5, "user_ratings_total": 7, "price_level": 2, "opening_hours": {"open_now": True}}
    (tmp_path / "near.json").write_text(json.dumps({"results": [place, {"place_id": "y", "name": "M"}]}))
    rows = readers.nearby(spark, str(tmp_path / "near.json"))
    flat = places.flatten(rows).orderBy("id").collect()
    assert [(r["id"], r["lat"], r["isOpen"]) for r in flat] == [("x", 1.0, True), ("y", None, None)]
    assert [r["placeId"] for r in places.pin(rows.withColumn("formatted_address", F.lit(None).cast("string"))).collect()] == ["x"]
    detail = {"place_id": "x", "result": {"photos": [{"photo_reference": "r", "width": 4, "height": 3, "html_attributions": []}], "reviews": [{"text": "t", "rating": 5}, {"text": None}]}}
    (tmp_path / "d.json").write_text(json.dumps(detail) + "\nnot json\n")
    assert readers.photos(spark, str(tmp_path / "d.json")).count() == 1
    assert [r["text"] for r in readers.reviews(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == ["t", None]
    (tmp_path / "m.json").write_text(json.dumps({"place_id": "x", "menuItems": [{"displayName": {"text": " "}}, {"displayName": {"text": "Soup"}}, {}]}) + "\n" + json.dumps({"place_id": "y"}))
    assert {r["place_id"]: r["items"] for r in readers.menus(spark, str(tmp_path / "m.json")).collect()} == {"x": ["Soup"], "y": []}
    (tmp_path / "p.png").write_bytes(b"abc")
    media = readers.media(spark, str(tmp_path / "p.png")).first()
    assert (media["data"], media["mime_type"]) == ("YWJj", "image/png")


def test_routes():
    assert readers.route({"placeId": "p", "lat": "1", "lng": "2"}) == ("details", ("p",))
    assert readers.route({"lat": "0", "lng": "2"}) == ("nearby", ("0", "2"))
    with pytest.raises(readers.RequestError) as e:
        readers.route({"lat": "1"})
    assert e.value.status == 400


def test_response_nests(spark):
    dishes = spark.createDataFrame([("p", i, f"d{i}") for i in range(25)], "key string, position int, id string")
    names = spark.createDataFrame([("p", ["A"]), ("q", ["B"])], "place string, names array<string>")
    got = {r["key"]: r for r in readers.response(dishes, names, "key").collect()}
    assert [d["id"] for d in got["p"]["dishes"]] == [f"d{i}" for i in range(20)]
    assert (got["q"]["dishes"], got["q"]["popularDishes"]) == ([], ["B"])
    assert json.loads(readers.as_json(dishes.limit(1)).first()["json"])["key"] == "p"


def test_coordinates_of_zero_are_missing(spark):
    row = spark.range(1).select(places.coordinate(F.lit(0.0), 5.0).alias("a"), places.coordinate(F.lit(1.0), 5.0).alias("b"), places.place_key(F.lit(""), F.lit("k")).alias("c")).first()
    assert tuple(row) == (5.0, 1.0, "k")


def test_nearest_each_equals_brute_force(spark):
    draw = random.Random(8)
    spots = [(i, draw.uniform(-60, 60), draw.uniform(-40, 40)) for i in range(60)] + [(100, 80.0, 10.0), (101, 80.9, 13.5), (102, 5.0, 179.9), (103, 89.5, -100.0), (104, None, 1.0)]
    asked = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(80)] + [(200, 80.0, 14.9), (201, 5.0, -179.9), (202, 89.9, 80.0), (203, -90.0, 0.0), (204, 90.2, 0.0), (205, None, 0.0)]

    def metres(a, b, lat, lng):
        h = math.sin(math.radians(lat - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(lng - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))

    got = places.nearest_each(spark.createDataFrame(asked, "request int, lat double, lng double"), spark.createDataFrame(spots, "id int, lat double, lng double"), "id").collect()
    want = {r: None if a is None else min((metres(a, b, y, x), i) for i, y, x in spots if y is not None)[1] for r, a, b in asked}
    assert len(got) == len(asked) and {r["request"]: r["id"] for r in got} == want


def test_nearest_each_sees_beyond_its_first_cells(spark):
    spots = spark.createDataFrame([(0, 81.9, 12.0), (1, 80.0, 14.01), (2, 0.0, -179.95), (3, 0.0, 170.0), (4, -80.0, 5.0)], "id int, lat double, lng double")
    asked = spark.createDataFrame([(0, 80.0, 12.01), (1, 0.0, 179.95), (2, -20.0, 60.0), (3, float("nan"), 0.0)], "request int, lat double, lng double")
    got = {r["request"]: (r["id"], r["distance"]) for r in places.nearest_each(asked, spots, "id").collect()}
    assert (got[0][0], got[1][0], got[2][0], got[3]) == (1, 2, 4, (None, None)) and got[0][1] == pytest.approx(38_600, rel=0.01)
    assert {r["id"] for r in places.nearest_each(asked, spots.limit(0), "id").collect()} == {None}


def test_nearest_each_in_crowds(spark):
    """A third of all places in one spot, a third at one point, the same for requests; and names that all share."""
    draw = random.Random(9)
    spread = lambda i: (i, draw.uniform(-80, 80), draw.uniform(-170, 170)) if i % 3 == 0 else (i, 10 + draw.uniform(0, 1e-4), 20.0) if i % 3 == 1 else (i, 10.0, 20.0)
    spots, asked = [spread(i) for i in range(900)], [spread(i) for i in range(300)]
    table = lambda rows, first: spark.createDataFrame([(*r, "Shared ") for r in rows], f"{first} int, lat double, lng double, name string")
    got = {r["request"]: r["id"] for r in places.nearest_each(table(asked, "request"), table(spots, "id"), "id", leaf=20).collect()}
    far = lambda a, b: math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    near = {a[0]: min((far(a, p), p[0]) for p in spots) for a in asked}
    assert all(got[r] == i or far(asked[r], spots[got[r]]) == pytest.approx(d, rel=1e-6, abs=1e-18) for r, (d, i) in near.items())
    named = places.business_by_name(table(asked, "place"), table(spots, "id").withColumn("name", F.lit(" shared")), "place", "id").collect()
    assert {r["place"]: r["business_id"] for r in named} == got
    other = places.business_by_name(table(asked[:3], "place"), table(spots, "id").withColumn("name", F.lit("other")), "place", "id").collect()
    assert [r["business_id"] for r in other] == [None] * 3


def test_places_without_photos_or_reviews_keep_empty_lists(spark):
    texts = ['{"place_id": "a", "result": {"photos": [{"photo_reference": "r", "width": 1, "height": 2}]}}', '{"place_id": "b", "result": {}}', '{"place_id": "c"}', "no json"]
    rows = spark.createDataFrame([(t,) for t in texts], "json string")
    got = {r["place_id"]: (len(r["photos"]), len(r["reviews"])) for r in readers.details_lists(readers.parsed(rows, "json", readers.schemas.DETAILS_RESPONSE)).collect()}
    assert got == {"a": (1, 0), "b": (0, 0), "c": (0, 0), None: (0, 0)}


def test_recorded_content_types_come_first(spark, tmp_path):
    for name in ("a.png", "b.png", "c.bin"):
        (tmp_path / name).write_bytes(b"x")
    types = spark.createDataFrame([(f"file:{tmp_path}/a.png", "image/webp; q=1"), (f"file:{tmp_path}/c.bin", " ")], "path string, content_type string")
    got = {r["path"][-5:]: r["mime_type"] for r in readers.media(spark, str(tmp_path), types).collect()}
    assert got == {"a.png": "image/webp", "b.png": "image/png", "c.bin": "image/jpeg"}


def test_routed_equals_route(spark):
    cases = [(p, a, b) for p in ("p", "", None) for a in ("1", "", None) for b in ("2", None)]
    rows = spark.createDataFrame(cases, "p string, a string, b string").select("*", readers.routed(F.col("p"), F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        try:
            want = readers.route({"placeId": r["p"], "lat": r["a"], "lng": r["b"]})[0]
        except readers.RequestError:
            want = "bad"
        assert r["r"] == want
