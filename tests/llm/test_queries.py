import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gleaner.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_every_operator_is_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs) and len(ours) > 0
    text = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else x
    rows = lambda df: sorted((tuple(map(text, r)) for r in df[sorted(df)].astype(object).itertuples(index=False)), key=str)
    assert rows(ours) == rows(theirs)


def test_pipeline_by_its_stages(spark):
    """Each stage against what its decisions must be, on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "SentencePiece"]
    before = docs
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SMALL).cache()
        tables.append(before.toPandas())
    told, one, cut, mix, pieces = tables
    assert all(list(t.columns) == docs.columns for t in tables[:-1])
    assert set(told["doc_id"]) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}
    assert len(one) == one["doc_id"].nunique() and set(one["doc_id"]) <= set(told["doc_id"]) and one["text"].nunique() == len(one)
    windows = {}
    for d, t in sorted(zip(cut["doc_id"], cut["text"])):
        w = t.split()
        for k in range(len(w) - 12):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(d)
    assert (cut["n_chars"] == cut["text"].str.len()).all()
    words = lambda t: t["text"].str.split().str.len().sum()
    assert words(cut) <= words(one)
    assert 1.3 * words(cut) < words(mix) < 1.7 * words(cut) and mix.groupby("doc_id").size().max() <= 2
    assert len(pieces) == len(mix) and pieces["round_trip"].all() and (pieces["n_pieces"] == pieces["piece_ids"].map(len)).all()
