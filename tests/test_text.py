from pyspark.sql import functions as F

from gleaner.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_trim_knows_unicode_spaces(spark):
    assert one(spark, "  \t a b\n﻿", text.js_trim) == "a b"


def test_clean_phrase(spark):
    assert one(spark, " (\"spicy \n ramen).'", text.clean_phrase) == "spicy ramen"
    assert one(spark, "", text.clean_phrase) == ""


def test_title_case(spark):
    assert one(spark, "pAD thai-bowl", text.title_case) == "Pad Thai-bowl"


def test_answer_text(spark):
    assert one(spark, "Ramen\nmore text", text.answer_text) == "Ramen"
    assert one(spark, " NULL ", text.answer_text) is None
    assert one(spark, None, text.answer_text) is None
    assert one(spark, "x" * 100, text.answer_text) == "x" * 80


def test_mime_type(spark):
    assert one(spark, " image/png ; q=1", text.mime_type) == "image/png"
    assert one(spark, ";", text.mime_type) == "image/jpeg"
    assert one(spark, None, text.mime_type) == "image/jpeg"


def test_numbered(spark):
    assert one(spark, ["a", "b"], text.numbered, "array<string>") == "1. a\n2. b"


def test_uri_component(spark):
    assert one(spark, "a b/é!'()~*", text.uri_component) == "a%20b%2F%C3%A9!'()~*"


def test_query_param(spark):
    url = "http://h/p?a=1&b=x%20y&c#d?e=2"
    assert one(spark, url, lambda x: text.query_param(x, "b")) == "x y"
    assert one(spark, url, lambda x: text.query_param(x, "c")) == ""
    assert one(spark, url, lambda x: text.query_param(x, "e")) is None


def test_caption_names(spark):
    cases = {
        "The pad thai": "Pad Thai",
        "x": None,
        "I tried the lamb korma, and it was great.": "Lamb Korma",
        'They call it "Old Pie" here. Nice.': "Old Pie",
        "Their soup, yes, and then some more words so that this is not short.": "Soup",
        "": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "x string, want string").select("x", "want", text.caption_name(F.col("x")).alias("got"))
    assert [r for r in rows.collect() if r["got"] != r["want"]] == []
