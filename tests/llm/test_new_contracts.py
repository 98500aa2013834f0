"""The queries of operators 11 to 13 themselves, over small tables of awkward rows, against brute force."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
from test_byte_repeats import brute as bytes_brute
from test_byte_repeats import made as bytes_made
from test_collocations import brute as phrases_brute
from test_collocations import made as phrases_made
from test_prefix_trie import brute as trie_brute
from test_prefix_trie import made as trie_made

from gleaner.llm import queries


def table(rows, *columns):
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])


def test_op11(spark, tmp_path):
    rows = phrases_made(7) * 2
    pq.write_table(table([(i, t, lang) for i, (lang, t) in enumerate(rows)], ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())), tmp_path / "documents.parquet")
    got = queries.op11_collocations(spark, str(tmp_path))
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    assert sorted(map(tuple, got.collect())) == phrases_brute(rows, 30)


def test_op12(spark, tmp_path):
    rows = trie_made(5)
    pq.write_table(table(rows, ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())), tmp_path / "conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == trie_brute(rows)


def test_op13(spark, tmp_path):
    rows = bytes_made(8, 400, 40)
    pq.write_table(table(rows, ("doc_id", pa.int64()), ("text", pa.string())), tmp_path / "documents.parquet")
    got = sorted(map(tuple, queries.op13_byte_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in bytes_brute(rows, 400)], key=str)
