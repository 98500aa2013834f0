"""Columns whose names differ in case only from those that the operators read."""

import pytest
from pyspark.sql import functions as F

from gleaner.llm import collision_search, mixing, rabitq, simhash


def test_documents(spark):
    docs = spark.createDataFrame([(i, f"one two three {i % 2}", "s", 0, "x", None) for i in range(6)], "doc_id long, text string, source string, DOC_ID int, Text string, Source string")
    assert {tuple(r)[2] for r in simhash.near_duplicates(docs, shingle=3).collect()} <= {0, 1}
    assert mixing.mix(docs).agg(F.sum("size")).first()[0] == 24


@pytest.mark.parametrize("run", [lambda v: rabitq.near_duplicates(v, 0.9), lambda v: collision_search.search(v, F.col("vec_id") % 2 == 0)])
def test_vectors(spark, run):
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i, 0.0, 0.0], "x", None) for i in range(6)], "vec_id long, embedding array<double>, VEC_ID string, Embedding string")
    assert run(vectors).count() >= 6
