import os

import pytest

import __spark_entry__ as contract
from gleaner.plans import catalogue, oracles

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_each_query_of_the_catalogue_has_sql():
    assert set(catalogue.QUERIES) == set(oracles.ORACLES)


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.abspath(contract.__file__))
    for folder, _, files in os.walk(os.path.join(root, "gleaner")):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, f)) as text:
                    assert "gleaner.llm" not in text.read(), f


@needs_data
def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    ours = catalogue.QUERIES[name](spark, SMALL).toPandas()
    theirs = con.sql(oracles.ORACLES[name]).df()
    assert len(ours) == len(theirs) and sorted(ours) == sorted(theirs)

    def rows(df):
        text = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
        return sorted((tuple(map(text, r)) for r in df[sorted(df)].astype(object).itertuples(index=False)), key=str)

    assert rows(ours) == rows(theirs)
    if name != "nearest_place":
        assert len(ours) > 0


@needs_data
def test_scores_and_positions_hold_their_invariants(spark):
    rows = catalogue.photo_ranking(spark, SMALL).collect()
    assert {r["score"] for r in rows} <= {5, 10, *range(31, 39), 50, *range(101, 109)}
    by = {}
    for r in rows:
        by.setdefault(r["l_suppkey"], []).append(r["position"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for r in catalogue.bucket_order(spark, SMALL).collect():
        found = list(map(int, r["positions"].split(",")))
        assert found == sorted(found)
