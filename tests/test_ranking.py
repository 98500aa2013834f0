from pyspark.sql import functions as F

from gleaner.operators import matching, ranking


def test_candidate_order(spark):
    rows = spark.createDataFrame([("a", 0, 3, 4), ("a", 1, 4, 3), ("a", 2, 3, 3)] + [("b", i, 4, 3) for i in range(25)], "place string, ord int, width int, height int")
    got = ranking.candidates(rows, "place", F.col("height") > F.col("width"), ["ord"]).orderBy("place", "candidate").collect()
    assert [r["ord"] for r in got if r["place"] == "a"] == [1, 2, 0]
    assert [r["ord"] for r in got if r["place"] == "b"] == list(range(20))


def test_scores(spark):
    cases = [("Ramen", True, True, 108), ("Gyoza Plate", True, True, 107), ("Salad", True, True, 50), ("gyoza", False, True, 37), ("Salad", False, True, 10), (None, False, True, 5), (None, False, False, -1)]
    rows = spark.createDataFrame(cases, "name string, is_match boolean, is_food boolean, want int")
    score = ranking.priority(F.col("name"), F.col("is_match"), F.col("is_food"), F.array(F.lit("Ramen"), F.lit("Gyoza")))
    assert all(r["want"] == r["got"] for r in rows.select("want", score.alias("got")).collect())


def test_rank_drops_what_is_no_food_and_counts_on(spark):
    rows = spark.createDataFrame([("p", 1, 10), ("p", 2, -1), ("p", 3, 50), ("p", 4, 10)], "place string, candidate int, score int")
    got = ranking.rank(rows, "place", "google").orderBy("position").collect()
    assert [(r["id"], r["candidate"]) for r in got] == [("google-p-0", 3), ("google-p-1", 1), ("google-p-2", 4)]


def test_attribution(spark):
    link = '<a href="https://maps.google.com/maps/contrib/1">Ann</a>'
    cases = [([], "user"), ([link], "user"), ([link.replace("Ann", "Ann Bowner")], "owner"), (["https://other.example.com"], "owner")]
    rows = spark.createDataFrame(cases, "links array<string>, want string").select("want", ranking.attribution(F.col("links")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_buckets_follow_scores(spark):
    cases = [("x", True, 0), ("x", False, 1), (None, False, 2), ("", False, 2)]
    rows = spark.createDataFrame(cases, "name string, m boolean, want int").select("want", ranking.bucket(F.col("m"), F.col("name")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_zip_moves_names_up(spark):
    rows = spark.createDataFrame([(["u", "v", "w"], ["", "a", None, "b"])], "urls array<string>, names array<string>")
    got = rows.select(ranking.zip_names(F.col("urls"), F.col("names")).alias("z")).first()["z"]
    assert [(z["pos"], z["url"], z["name"], z["attribution"]) for z in got] == [(0, "u", "a", "owner"), (1, "v", "b", "user"), (2, "w", None, "user")]


def test_first_equal_keeps_the_list_spelling(spark):
    rows = spark.createDataFrame([("Ramen", ["ramen ", "Ramen"]), ("Gyoza", ["Ramen"]), ("x", None)], "text string, items array<string>")
    got = matching.match(rows, "text", "items").collect()
    assert [(r["name"], r["is_match"]) for r in got] == [("ramen ", True), ("Gyoza", False), ("x", False)]
    table = spark.createDataFrame([("k", 2, "RAMEN"), ("k", 1, " ramen")], "key string, ord int, item string")
    row = matching.match_table(spark.createDataFrame([("k", "Ramen")], "key string, text string"), table, "key").first()
    assert (row["name"], row["is_match"]) == (" ramen", True)


def test_reference_list(spark):
    rows = spark.createDataFrame([([str(i) for i in range(70)], ["p"]), ([], [str(i) for i in range(30)]), (None, None)], "menu array<string>, popular array<string>")
    got = [len(r[0]) for r in rows.select(matching.reference_list(F.col("menu"), F.col("popular"))).collect()]
    assert got == [60, 20, 0]


def test_lexicon_filters(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "w string")
    assert [r["w"] for r in matching.in_lexicon(rows, "w", ("a",)).collect()] == ["a"]
    assert [r["w"] for r in matching.in_lexicon(rows, "w", ("a",), keep=False).collect()] == ["b", None]
