import random
import time

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import matching, places
from gleaner.operators.containment import containing


def made(seed):
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choices("abcé\U0001f35c ", k=k))
    return [(draw.choice("pqq") if draw.random() > 0.05 else None, word(draw.choice([0, 1, 2, 3, 5, 12]))) for _ in range(200)] + [("q", None), ("q", "hot " * 50)]


def test_pairs_equal_brute_force(spark):
    a, b = made(1), made(2)
    got = containing(spark.createDataFrame(a, "k string, needle string"), spark.createDataFrame(b, "k string, hay string"), ["k"]).collect()
    want = {(k, n, h) for k, n in a for j, h in b if k is not None and k == j and n and h is not None and n in h}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = containing(spark.createDataFrame(a, "k string, needle string").select("needle"), spark.createDataFrame(b, "k string, hay string").select("hay")).collect()
    assert {tuple(r) for r in got} == {(n, h) for _, n in a for _, h in b if n and h is not None and n in h}
    assert containing(spark.createDataFrame([], "needle string"), spark.createDataFrame(b, "k string, hay string").select("hay")).count() == 0


def test_no_product_is_planned(spark):
    plan = containing(spark.createDataFrame(made(1), "k string, needle string"), spark.createDataFrame(made(2), "k string, hay string"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_containing_equals_the_list_form(spark):
    draw = random.Random(3)
    names = [(i, k, n) for i, (k, n) in enumerate(made(4))]
    items = [(k, n, draw.randint(0, 10**6)) for k, n in made(5)]
    got = {r["i"]: r["idx"] for r in matching.first_containing(spark.createDataFrame(names, "i int, place string, text string"), spark.createDataFrame(items, "place string, item string, ord int"), "place").collect()}
    for i, k, n in names:
        hit = [o for j, x, o in items if k is not None and j == k and n is not None and x is not None and (n.lower() in x.lower() or x.lower() in n.lower())]
        assert got[i] == min(hit, default=-1)


def test_many_searches(spark):
    stock = spark.createDataFrame([("1", "Red Café", "Main St"), ("2", None, "red lane"), ("3", "x", None), ("4", "Red Café", "")], "id string, name string, address string")
    asked = spark.createDataFrame([(1, "RED"), (2, "é"), (3, ""), (4, None), (5, "nothing"), (6, "x"), (7, "red")], "request int, text string")
    got = sorted(map(tuple, places.search_each(asked, stock, "id").collect()))
    assert got == [(1, "1"), (1, "2"), (1, "4"), (2, "1"), (2, "4"), (6, "3"), (7, "1"), (7, "2"), (7, "4")]


def test_a_common_search_is_dealt_over_tasks(spark):
    stock = [(i, f"place {i % 7}" if i % 5 else None, "lane 3" if i % 2 else "") for i in range(90)] + [(3, "place 3", "lane 3")]
    asked = [(r, "PLACE" if r % 3 else "3") for r in range(120)] + [(1, "lane"), (1, "3"), (1, "place"), (None, "3"), (None, "lane"), (None, None), (500, "")]
    rows, requests = spark.createDataFrame(stock, "id int, name string, address string"), spark.createDataFrame(asked, "request int, text string")
    want = {(r, i) for r, t in asked if t for i, *texts in stock if any(t.lower() in (x or "").lower() for x in texts)}
    for block in (7, 1000):
        got = places.search_each(requests, rows, "id", block=block).withColumn("task", F.spark_partition_id()).collect()
        pairs = [(r["request"], r["id"]) for r in got]
        assert set(pairs) == want and len(pairs) == len(want)
        assert block == 1000 or len({r["task"] for r in got if (r["request"] or 0) > 1 and r["request"] % 3}) > 1


def test_nothing_that_grows_goes_through_the_driver(spark):
    asked, stock = spark.createDataFrame([(1, "RED"), (1, "lane"), (2, "re")], "request int, text string"), spark.createDataFrame([("1", "Red Café", "Main St"), ("2", None, "red lane")], "id string, name string, address string")
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    for df, rows in ((containing(spark.createDataFrame(made(1), "k string, needle string"), spark.createDataFrame(made(2), "k string, hay string"), ["k"]), None), (places.search_each(asked, stock, "id"), [(1, "1"), (1, "2"), (2, "1"), (2, "2")])):
        assert rows is None or sorted(map(tuple, df.collect())) == rows
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [p.physicalPlanDescription() for p in (runs.executionsList(before, 1000).apply(i) for i in range(runs.executionsList(before, 1000).size()))]
    assert any("Join" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_utf16_units(spark):
    values = ["", "abc", "é", "\U0001f35c", "a\U0001f35cb", "\U0001f35c" * 50, None]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", text.units(F.col("x")).alias("n"), *[text.first_units(F.col("x"), k).alias(f"u{k}") for k in (1, 2, 3, 80)]).collect()
    for r in rows:
        if r["x"] is None:
            assert r["n"] is None and r["u1"] is None
            continue
        code = r["x"].encode("utf-16-be")
        assert r["n"] == len(code) // 2
        for k in (1, 2, 3, 80):
            assert r[f"u{k}"] == code[: 2 * k].decode("utf-16-be", "ignore")
    bowl = "\U0001f35c"
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one(bowl * 41, text.answer_text) == bowl * 40
    assert one(bowl + "x" * 90, text.answer_text) == bowl + "x" * 78
    assert one("a" + bowl, text.caption_name) == "A" + bowl and one(bowl, text.caption_name) is None


def test_long_runs_are_trimmed_in_linear_time(spark):
    long = "x" + " " * 1_000_000 + "y" + "!" * 1_000_000 + "z"
    df = spark.createDataFrame([(long,)], "x string").cache()
    df.count()
    began = time.time()
    r = df.select(text.js_trim(F.col("x")).alias("a"), text.clean_phrase(F.concat(F.col("x"), F.lit("!! "))).alias("b")).first()
    assert r["a"] == long and r["b"] == "x y" + "!" * 1_000_000 + "z" and time.time() - began < 5
