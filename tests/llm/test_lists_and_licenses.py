import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.llm import licenses, url_lists

D = datetime.date.fromisoformat


def entries(spark, rows):
    return spark.createDataFrame([(d, a, D(t) if t else None) for d, a, t in rows], "domain string, action string, day date")


LIST = [("bad.example.com", "add", "2023-01-10"), ("bad.example.com", "remove", "2023-02-01"), ("BAD.example.com", "add", "2023-03-01"), ("bad.example.com", "add", "2023-04-01"),
        ("example.com", "add", "2023-01-20"), ("example.com", "remove", "2023-01-25"), ("x.org", "remove", "2023-01-01"), ("y.org", "add", "2023-01-01"), ("y.org", "remove", "2023-01-01"),
        (None, "add", "2023-01-01"), ("z.org", "add", None), ("z.org", None, "2023-01-01")]


def test_intervals(spark):
    got = {tuple(r) for r in url_lists.intervals(entries(spark, LIST)).collect()}
    assert got == {("bad.example.com", D("2023-01-10"), D("2023-02-01")), ("bad.example.com", D("2023-03-01"), None), ("example.com", D("2023-01-20"), D("2023-01-25"))}


def test_captures_see_the_list_of_their_day(spark):
    cases = [
        ("http://bad.example.com/x", "2023-01-09", None), ("http://bad.example.com/x", "2023-01-10", "bad.example.com"), ("HTTPS://u@www.BAD.example.com.:80/x", "2023-01-22", "bad.example.com"),
        ("http://bad.example.com", "2023-02-01", None), ("http://bad.example.com?q", "2024-01-01", "bad.example.com"), ("http://notbad.example.com/", "2023-01-20", "example.com"),
        ("http://notbad.example.com/", "2023-01-25", None), ("http://example.com.evil.org/", "2023-01-21", None), ("http://x.org", "2023-06-01", None), ("http://y.org", "2023-06-01", None),
        ("ftp://bad.example.com/", "2023-01-10", None), ("", "2023-01-10", None), (None, "2023-01-10", None), ("http://bad.example.com/x", None, None), ("http:///x", "2023-01-10", None),
        ("http://" + "a." * 3000 + "bad.example.com/x", "2023-01-10", "bad.example.com"),
    ]
    rows = [(i, u, D(t) if t else None, "own", "own", want) for i, (u, t, want) in enumerate(cases)]
    captures = spark.createDataFrame([*rows, rows[1]], "id int, url string, fetched date, domain string, host string, want string")
    got = url_lists.filter_captures(captures, entries(spark, LIST)).collect()
    assert len(got) == len(cases) + 1
    assert [(r["id"], r["list_domain"]) for r in got if r["list_domain"] != r["want"]] == []
    assert all(r["listed"] == (r["want"] is not None) and r["domain"] == "own" for r in got)


def test_a_listed_domain_of_many_labels_covers_its_subdomains(spark):
    domain = "a.b.c.d.e.f.g.h.i.org"
    captures = spark.createDataFrame([(f"http://{x}{domain}/", D("2023-01-02")) for x in ("", "x.", "y.x.", "not")], "url string, fetched date")
    got = url_lists.filter_captures(captures, entries(spark, [(domain, "add", "2023-01-01")])).collect()
    assert {r["host"].removesuffix(domain): r["list_domain"] for r in got} == {"": domain, "x.": domain, "y.x.": domain, "not": None}


def test_no_list_and_no_captures(spark):
    captures = spark.createDataFrame([("http://a.b/", D("2023-01-01"))], "url string, fetched date")
    assert [r["listed"] for r in url_lists.filter_captures(captures, entries(spark, [])).collect()] == [False]
    assert url_lists.filter_captures(captures.limit(0), entries(spark, LIST)).collect() == []


def normal(passage):
    import re

    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), passage)).strip()


def dice(passage, template):
    grams = lambda t: [tuple(p) for w in [normal(t).split()] for p in zip(w, w[1:])]
    a, b = grams(passage), set(grams(template))
    return 2 * len(set(a) & b) / (len(a) + len(b)) if a else 0.0


def passages(text):
    import re

    found = text.split("\n") + re.split(licenses.SENTENCES, text) + re.split(licenses.PARAGRAPHS, text)
    return set(map(normal, found))


def test_licences_equal_brute_force(spark):
    notices = list(licenses.TEMPLATES.values())
    texts = [f"First line.\n{n}\nLast one" for n in notices] + [n.upper().replace(" ", "  ").replace(".", " . ") for n in notices]
    texts += ["Licensed under the Apache License, Version 2.0 .", "licensed under the apache license version 3", "Released under the MIT License. Or not.", "", None, "MIT", "\n\n", "word " * 50_000]
    texts += ["Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0", "text Licensed under CC BY 4.0. text", "license software warranty " * 2000]
    rows = [(i if i else None, t, "own") for i, t in enumerate(texts)]
    for threshold in (0.9, 0.6):
        got = {r["doc_id"] or 0: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), threshold=threshold).collect()}
        assert len(got) == len(rows)
        for i, t in enumerate(texts):
            scores = [max((dice(p, v), [-ord(c) for c in k.split("#")[0]], k.split("#")[0]) for k, v in licenses.TEMPLATES.items()) for p in passages(t or "")]
            scores = [s for s in scores if s[0] >= threshold]
            r = got[i]
            assert r["license_passages"] == len(scores), (i, t)
            if scores:
                best = max(s[0] for s in scores)
                assert r["dice"] == pytest.approx(best) and r["license"] == min(s[2] for s in scores if s[0] == best)
            else:
                assert (r["license"], r["dice"]) == (None, None)


def test_wrapped_and_embedded_licences_are_found(spark):
    import textwrap

    wrap = lambda key, mark, width=60: "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[key], width))
    code = "int main() {\n  return 0;\n}\n"
    cases = [
        (f"Copyright (c) 2020 Someone\n\n{wrap('MIT#3', '')}\n\n{wrap('MIT#4', '')}\n\n{wrap('MIT#5', '')}\n", "MIT", 3),
        (f"/*\n * Copyright 2021\n *\n{wrap('Apache-2.0#3', ' * ')}\n *\n{wrap('Apache-2.0#4', ' * ')}\n */\n{code}", "Apache-2.0", 2),
        (f"# Copyright\n#\n{wrap('BSD-2-Clause', '# ')}\n#\n{wrap('BSD-2-Clause#2', '# 1. ', 200)}\n#\n{wrap('BSD-2-Clause#4', '# ')}\n{code}", "BSD-2-Clause", 2),
        (f"-- {licenses.TEMPLATES['ISC']}", "ISC", 1),
        ("Some words come first. Released under the MIT License. And some follow it.", "MIT", 1),
        (f"{wrap('GPL-3.0#2', '// ')}\n//\n{wrap('GPL-3.0#3', '// ')}\n{code}", "GPL-3.0", 1),
        ("The software comes with a license, and its warranty is limited in some respects.", None, 0),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (text, name, least) in enumerate(cases):
        assert got[i]["license"] == name and got[i]["license_passages"] >= least, (text, got[i])


def test_long_runs_take_linear_time_and_no_stack(spark):
    import time

    notice = licenses.TEMPLATES["MIT#2"] if "MIT#2" in licenses.TEMPLATES else licenses.TEMPLATES["MIT"]
    runs = ["\n" * 1_000_000, "." * 1_000_000, " " * 1_000_000, ". \n" * 300_000, "\n \t" * 300_000, "!?" * 500_000 + " ", "é" * 500_000 + "\n"]
    rows = [(i, f"software license warranty x{r}{notice}{r}y") for i, r in enumerate(runs)]
    began = time.time()
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    for i in (0, 3, 4):
        assert got[i] == "MIT", i


def test_passages_are_cut_where_the_patterns_say(spark):
    import random

    draw = random.Random(2)
    texts = ["".join(draw.choices(["a", "B1", " ", ".", "!", "\n", "\t", "\r", "é", "-", ";"], k=draw.randint(0, 40))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", licenses.passages_of(F.col("text")).alias("p")).collect()
    for r in got:
        assert set(r["p"]) - {""} == passages(texts[r["i"]]) - {""}, repr(texts[r["i"]])


def test_columns_that_differ_in_case(spark):
    docs = spark.createDataFrame([(1, f"x\n{licenses.TEMPLATES['MIT']}\ny", "own", 1, 2)], "doc_id long, text string, License string, Text int, DICE int")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "text", "Text", "license", "dice", "license_passages"]
    assert tuple(got.first())[2:4] == (1, "MIT")
    captures = spark.createDataFrame([(1, "http://a.b/", D("2023-01-01"), "own", "x")], "id int, url string, fetched date, HOST string, Url string")
    got = url_lists.filter_captures(captures, entries(spark, LIST))
    assert got.columns == ["id", "url", "fetched", "Url", "host", "listed", "list_domain", "listed_since"] and tuple(got.first())[3:5] == ("x", "a.b")


def test_needles_are_in_every_passage_that_reaches_the_threshold():
    import random

    draw = random.Random(1)
    found = licenses.needles([licenses.bigrams(t) for t in licenses.TEMPLATES.values()], 0.9)
    for template in licenses.TEMPLATES.values():
        words = normal(template).split()
        for _ in range(50):
            w = list(words)
            for _ in range(draw.randint(0, max(1, len(w) // 12))):
                w[draw.randrange(len(w))] = "other"
            assert dice(" ".join(w), template) < 0.9 or any(n in x for n in found for x in w)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).collect() == []
    assert licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).first()["license_passages"] == 0
    assert licenses.bigrams("a b a b") == ["a b", "b a"]


def test_no_python_on_the_native_paths(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    captures = spark.createDataFrame([("http://a.b/", D("2023-01-01"))], "url string, fetched date").withColumn("id", F.lit(1))
    for df in (licenses.scan(docs), url_lists.filter_captures(captures, entries(spark, LIST))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
