import pytest
from pyspark.sql import functions as F

from gleaner.operators import phrases
from gleaner.operators.lexicon import FOOD, Lexicon

SMALL = Lexicon(
    triggers=("try the ", "had the ", "get the ", "ordered the "), parts=("ramen", "rice", "pizza", "bun", "cake", "taco"),
    stops=("the", "and", "it", "was", "i", "very"), known=("beef wellington", "salt and pepper"), praise=("amazing", "perfect"),
)

CASES = [
    (["Get the ramen."], ["Ramen"]),
    (["The ramen was amazing."], []),
    (["Wow! Ramen was amazing."], ["Ramen"]),
    (["Ramen was perfectly fine."], ["Ramen"]),
    (['We had the "sticky bun" today.'], ["Sticky Bun"]),
    (["Great 'rice bowl\" here"], ["Rice Bowl"]),
    (["Forget the cake!"], ["Cake"]),
    (["Had the licorice!"], ["Licorice"]),
    (["Try the rice and pizza."], []),
    (["I ordered the pizza today because rain came all day"], ["Pizza Today Because"]),
    (["Try the pizza tonight friends"], ["Pizza Tonight Friends"]),
    (["Try the pizza\nvery good"], []),
    (["Try the 5 tacos."], []),
    (["Try the beef wellington."], ["Beef Wellington"]),
    (["Try the salt and pepper."], []),
    (["Get the ramen. Get the ramen. Get the ramen.", "Try the spicy ramen."], ["Ramen"]),
    (["Get the cake. Try the ramen."], ["Ramen", "Cake"]),
    (["Get the cake.", "Try the ramen."], ["Cake", "Ramen"]),
    ([None], []),
]


def reviews(spark, cases):
    rows = [(str(i), n, text) for i, (texts, _) in enumerate(cases) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "place string, ord long, text string")


def test_fixture_cases(spark):
    got = {r["place"]: r["names"] for r in phrases.popular_phrases(reviews(spark, CASES), SMALL).collect()}
    assert {i: got.get(str(i), []) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_weights(spark):
    rows = phrases.phrase_weights(reviews(spark, [(['Get the ramen, "ramen", ramen was amazing'], [])]), SMALL).collect()
    assert {(r["phrase"], r["weight"]) for r in rows} == {("ramen", 6)}


def test_praise_may_start_within_a_word_after_a_match(spark):
    text = "cake is perfectly amazing pizza is perfect"
    import re

    want = [m.lower() for m in re.findall(r"([a-z]+(?:\s+[a-z]+){0,3})\s+(?:is|was|are|were)\s+(?:amazing|perfect)", text)]
    got = phrases.mentions(reviews(spark, [([text], [])]), Lexicon((), ("a", "e", "i", "o", "u", "y"), ("zz",), (), SMALL.praise)).orderBy("occurrence").collect()
    assert [r["phrase"] for r in got] == want


def test_crowded_places_go_in_rounds(spark):
    import random

    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6))) for _ in range(90)]
    texts = [f"get the {w}x{draw.choice(['', ' ' + draw.choice(words)])}." for w in words]
    lexicon = Lexicon(SMALL.triggers, ("a", "b", "c", "d", "e"), ("zz",))
    rows = spark.createDataFrame([("p", i, t.replace("x", "ab")) for i, t in enumerate(texts)], "place string, ord long, text string")
    whole = phrases.popular_phrases(rows, lexicon, most=40).first()["names"]
    parts = phrases.popular_phrases(rows, lexicon, most=40, at_once=11).first()["names"]
    assert parts == whole and len(whole) > 11
    nameless = phrases.popular_phrases(rows.withColumn("place", F.lit(None).cast("string")), lexicon, most=40, at_once=11).collect()
    assert [(r["place"], r["names"]) for r in nameless] == [(None, whole)]


def test_raw_phrases_are_valid_whatever_their_case_and_space(spark):
    cases = [("  Spicy\tRAMEN ", True), ("\u00a0Taco\u2003bowl", False), ("the ramen", False), ("Beef Wellington", True), ("beef  wellington", False), ("5 tacos", False), ("ramen a b c d e", False), ("x" * 38 + "bun", False), (None, None)]
    rows = spark.createDataFrame(cases, "p string, want boolean").select("p", "want", phrases.is_valid(F.col("p"), SMALL).alias("got")).collect()
    assert [(r["p"], r["got"]) for r in rows if r["p"] != "\u00a0Taco\u2003bowl"] == [c for c in cases if c[0] != "\u00a0Taco\u2003bowl"]
    assert [r["got"] for r in rows if r["p"] == "\u00a0Taco\u2003bowl"] == [True]


def test_empty(spark):
    empty = spark.createDataFrame([], "place string, ord long, text string")
    assert phrases.popular_phrases(empty, SMALL).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_same_at_any_partitioning(spark, parts):
    rows = reviews(spark, CASES).withColumn("place", F.lit("all"))
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    want = phrases.popular_phrases(rows, SMALL).first()["names"]
    assert phrases.popular_phrases(rows.repartition(parts), SMALL).first()["names"] == want


def test_food_lexicon_is_whole():
    assert (len(FOOD.triggers), len(FOOD.parts), len(FOOD.stops), len(FOOD.known), len(FOOD.praise)) == (17, 108, 126, 22, 8)
    assert all(t.endswith(" ") for t in FOOD.triggers)
