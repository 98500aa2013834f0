import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import asof, labels
from gleaner.sources import readers, recorded, schemas


def test_a_model_is_asked_only_where_those_before_it_failed(spark, tmp_path):
    log = str(tmp_path)
    answers = {1: [(200, "Ramen")], 2: [(429, None), (200, "gyoza")], 3: [(403, "x")], 4: [(500, None), (None, None)], 5: [], 6: [(200, "null")], 7: [(500, None), (403, None)], 8: "raises"}

    def model(k):
        def ask(row):
            with open(f"{log}/{k}-{row['id']}", "a") as f:
                f.write("x")
            if answers[row["id"]] == "raises":
                raise OSError("no answer")
            return answers[row["id"]][k]

        return ask

    rows = spark.createDataFrame([(i, ["Ramen", "Gyoza "], i != 5) for i in answers], "id int, items array<string>, fetched boolean").withColumn("NAMED", F.lit(1))
    got = labels.label_staged(rows, [model(0), model(1)], parallel=3)
    assert got.columns == ["id", "items", "fetched", "NAMED", "name", "is_match", "is_food"]
    found = {r["id"]: (r["name"], r["is_match"], r["is_food"]) for r in got.collect()}
    assert found == {1: ("Ramen", True, True), 2: ("Gyoza ", True, True), 3: (None, False, True), 4: (None, False, True), 5: (None, False, True), 6: (None, False, False), 7: (None, False, True), 8: (None, False, True)}
    got.count()  # reading again asks no one
    calls = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert calls == {name: "x" for name in ("0-1", "0-2", "0-3", "0-4", "0-6", "0-7", "0-8", "1-2", "1-4", "1-7", "1-8")}


def test_calls_are_bounded_in_time_and_number():
    now, most = [0], [0]

    def ask(row):
        now[0] += 1
        most[0] = max(most[0], now[0])
        time.sleep(5 if row["i"] == 3 else 0.02)
        now[0] -= 1
        return 200, str(row["i"])

    began = time.time()
    got = labels.ask_all(ask, [{"i": i} for i in range(8)], 2, 0.5)
    assert got == [(None, None) if i == 3 else (200, str(i)) for i in range(8)]
    assert time.time() - began < 3 and most[0] <= 3  # the late call still runs while others do


def test_asof_equals_brute_force(spark):
    draw = random.Random(6)
    users = ["hot"] * 6 + ["a", None]
    asked = [(i, draw.choice(users), draw.choice([None, draw.randint(0, 600_000)]) if i % 9 == 0 else draw.randint(0, 600_000)) for i in range(400)]
    given = [(i, draw.choice(users), draw.randint(0, 600_000), draw.random()) for i in range(200)] + [(500, "hot", 1000, 0.5), (501, "hot", 1000, 0.25)]
    at = F.timestamp_millis("ms").alias("ts")
    left = spark.createDataFrame(asked, "i int, user string, ms long").select("i", "user", at)
    right = spark.createDataFrame(given, "n int, user string, ms long, value double").select("n", "user", at, "value")
    got = {r["i"]: (r["value"], r["n"]) for r in asof.last_before(left, right, "user", "ts", 60, "n", ["value", "n"]).collect()}
    assert len(got) == len(asked)
    for i, user, ms in asked:
        hits = [(t, n, v) for n, u, t, v in given if u == user and user is not None and ms is not None and 0 <= ms - t <= 60_000]
        assert got[i] == ((max(hits)[2], max(hits)[1]) if hits else (None, None)), i
    assert asof.last_before(left, right.limit(0), "user", "ts", 60, "n", ["value"]).where("fix_at is not null").count() == 0
    assert asof.last_before(left.limit(0), right, "user", "ts", 60, "n", ["value"]).count() == 0


def test_a_filter_is_pushed_into_the_data_source(spark):
    rows = spark.createDataFrame([(f"p{i}", f'{{"name": "é{i}"}}') for i in range(300)] + [("q\"\\", "{}"), (None, "{}")], "place_id string, result string")
    path = recorded.record(rows)
    every = recorded.read(spark, path)
    assert every.count() == 301
    one = recorded.read(spark, path).where("place_id = 'p17'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(Python)" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # the source took it
    assert one.rdd.getNumPartitions() < every.rdd.getNumPartitions()
    assert [r["place_id"] for r in one.collect()] == ["p17"]
    some = recorded.read(spark, path).where(F.col("place_id").isin("p1", "p2", "none", 'q"\\'))
    assert sorted(r["place_id"] for r in some.collect()) == ["p1", "p2", 'q"\\']
    assert recorded.read(spark, path).where("place_id = 'p1' and place_id = 'p2'").count() == 0


def test_details_as_they_come(spark, tmp_path):
    lines = ['{"place_id": "a", "status": "OK", "result": {"name": "A", "formatted_address": "x", "geometry": {"location": {"lat": 1.5, "lng": 2}}, "opening_hours": {"open_now": false}}}', '{"place_id": "b", "status": "NOT_FOUND"}', '{"place_id": "c", "name": "flat"}', "no json"]
    (tmp_path / "d.json").write_text("\n".join(lines))
    got = {r["place_id"]: r for r in readers.details(spark, str(tmp_path / "d.json")).collect()}
    assert set(got) == {"a", "c"} and got["a"]["geometry"]["location"]["lat"] == 1.5 and got["a"]["opening_hours"]["open_now"] is False and got["c"]["name"] == "flat"
    assert readers.details(spark, str(tmp_path / "d.json"), "a").count() == 1
    assert "result" in schemas.PLACE_RESPONSE


def test_answers_and_their_status(spark):
    asked = spark.createDataFrame([(1, "details"), (2, "bad"), (3, "details"), (4, "nearby"), (4, "nearby")], "request int, route string")
    found = spark.createDataFrame([(1, "x"), (2, "never")], "request int, name string")
    got = sorted((r["request"], r["status"], r["body"]) for r in readers.answers(asked, found, spark.createDataFrame([(3,)], "request int")).collect())
    assert got == [(1, 200, '{"name":"x"}'), (2, 400, '{"error":"bad request"}'), (3, 500, '{"error":"failed"}'), (4, 404, '{"error":"not found"}'), (4, 404, '{"error":"not found"}')]


def test_twenty_reviews_give_names(spark):
    reviews = spark.createDataFrame([("b", i, "ok" if i % 2 else f"Dish number {i}") for i in range(60)], "business_id string, ord int, text string")
    got = readers.business_photos(spark.createDataFrame([("b", [f"u{i}" for i in range(12)]), ("c", ["v"])], "business_id string, photos array<string>"), reviews).collect()
    by = {(r["business_id"], r["pos"]): r["name"] for r in got}
    assert [by["b", i] for i in range(12)] == [f"Dish Number {2 * i}" for i in range(10)] + [None, None] and by["c", 0] is None


@pytest.mark.parametrize("text,want", [('{"a":[{"b":3}]}', 3), ('{"a":[{"b":"x"}]}', None), ('{"a":{"b":3}}', None), ("{", None), (None, None), ('{"a":[{"b":{"c":1}}]}', None)])
def test_deep_paths(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias("v") for c in readers.at_paths(F.col("t"), {"$.a[0].b": "int"}).values()]).first()
    assert row["v"] == want


def test_calls_share_threads_and_late_ones_are_left_behind():
    seen = set()

    def ask(row):
        seen.add(threading.current_thread().name)
        if row["k"] == 50:
            time.sleep(1.0)
        if row["k"] == 51:
            raise SystemExit
        return 200, str(row["k"])

    got = labels.ask_all(ask, [{"k": k} for k in range(200)], 4, 0.3)
    assert got == [(None, None) if k in (50, 51) else (200, str(k)) for k in range(200)]
    assert len(seen) <= 8  # four, and four after the late one


def test_requests_in_one_partition_are_asked_by_several_tasks(spark):
    rows = spark.range(0, 200, 1, 1).select("id", F.array(F.lit("a")).alias("items"), F.lit(True).alias("fetched"))

    def ask(row):
        time.sleep(0.02)
        return 200, f"worker {os.getpid()}"

    got = labels.label_staged(rows, [ask]).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and len({r["name"] for r in got}) > 1
