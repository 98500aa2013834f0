"""Each stage of the pipeline over awkward rows."""

import random

import pytest

import corpus_pipeline
from gleaner.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out int, n_words string, n_removed long, taken string, times long, component_id string, spans string"
NEW = " ".join(f"new{i}" for i in range(60))
OWN = (7.5, "own", 3, "own", 99, "own", 5, "own", "own")


def documents(n=60):
    draw = random.Random(21)
    words = "the house and garden where children were playing with their friends this morning under old trees near a river".split()
    rows = []
    for i in range(n):
        text = " ".join(f"{draw.choice(words)}{draw.choice(['', '', 's', 'ly'])}" for _ in range(draw.choice([30, 80, 200])))
        rows.append((i, text, "en", draw.choice(["a", "a", "b", None])))
    long = " ".join(f"{draw.choice(words)}{i % 97}x" for i in range(30_000))
    copied = next(r[1] for r in rows if len(r[1].split()) == 80)
    edited = copied.split()
    edited[5] = "Different"
    rows += [(100, copied, "en", "b"), (101, " ".join(edited), "en", "b"), (102, f"{NEW} {copied} and more at last", "en", "a"), (103, None, "en", "a"), (104, "", None, "b"),
             (105, " \n\t", "en", "a"), (106, "12 34 ²", "en", "a"), (None, "a text without any name but with some words", None, "b"), (None, None, None, None), (107, long, "en", "c"), (5, rows[5][1], "en", "a")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *OWN) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_awkward_rows(spark, name):
    rows, stage = documents(), dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, rows)
    out = stage(spark, docs, "")
    got = [r.asDict() for r in out.collect()]
    if name != "SentencePiece":
        assert out.columns == docs.columns and out.schema == docs.schema
        assert all(tuple(r[c] for c in docs.columns[4:]) == OWN for r in got)
    ids = sorted((r["doc_id"] for r in got), key=str)
    text = {r["doc_id"]: r.get("text") for r in got}
    every = sorted((r[0] for r in rows), key=str)
    if name == "language ID":
        gone = [103, 104, 105, 106]
        assert sorted([*ids, *gone, None], key=str) == every and all(text[r[0]] == r[1] for r in rows if r[0] in text and r[0] is not None)
    elif name == "SimHash near-dedup":
        assert sorted([*ids, 100, 101, 104, 105], key=str) == every
    elif name == "substring dedup":
        assert sorted([*ids, 100], key=str) == every
        assert 6 <= len(text[101].split()) < 13
        assert text[102] == f"{NEW} and more at last"
        assert [r["text"] for r in got if r["doc_id"] == 5] == [rows[5][1]] * 2 and text[107] == next(r[1] for r in rows if r[0] == 107) and text[103] is None
    elif name == "mixing":
        size = {}
        for i, t, _, s in rows:
            size[s] = size.get(s, 0) + len((t or "").split())
        names = sorted(size, key=lambda s: (s is None, s or ""))
        want = dict(zip(names, mixing.targets([size[s] for s in names], [5, 2, 1, 5], 1.5 * sum(size.values()))))
        took = dict.fromkeys(names, 0)
        for r in got:
            took[r["source"]] += len((r["text"] or "").split())
        assert all(abs(took[s] - want[s]) <= (30_000 if s == "c" else 2 * 210) + 3 * mixing.BLOCK for s in names), (took, want)
        assert max(ids.count(i) for i in {*ids} - {None, 5}) <= 2
    else:
        assert ids == every and all(r["round_trip"] and r["parity"] and r["score"] == 7.5 and r["n_pieces"] == len(r["piece_ids"]) for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_an_empty_table(spark, name):
    docs = table(spark, documents()).limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.collect() == [] and (name == "SentencePiece" or out.columns == docs.columns)


def test_each_source_has_its_target(spark):
    """Straight from the test table: the stage's words by source, over the targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = lambda df: {r["source"]: sum(len(t.split()) for t in r["t"]) for r in df.groupBy("source").agg({"text": "collect_list"}).withColumnRenamed("collect_list(text)", "t").collect()}
    size, got = words(docs), words(corpus_pipeline.mixed(spark, docs, ""))
    largest = {r["source"]: r["n"] for r in docs.selectExpr("source", "size(split(trim(text), '\\\\s+')) as n").groupBy("source").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    names = sorted(size)
    want = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))))
    assert all(abs(got[s] - want[s]) <= 2 * largest[s] + 4 * mixing.BLOCK for s in names), {s: got[s] / want[s] for s in names}
