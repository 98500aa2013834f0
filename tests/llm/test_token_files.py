import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's 12 o'clock, NAÏVE café x y", "", None, " \t\n", "<|endoftext|> in text", "é ﬁ Σας İ 😀", "word " * 30_000, "word " * 30_000]


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_words_apart_encode_as_whole_texts():
    texts = [t or "" for t in TEXTS]
    ids, n = token_files.encode_texts([t.encode() for t in texts], PATH)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts]


def test_any_id_is_read_without_the_others():
    draw = np.random.default_rng(1)
    ids = np.concatenate([draw.integers(0, 2**k, 700, dtype=np.uint64).astype(np.uint32) for k in (8, 9, 16, 17, 32)])
    draw.shuffle(ids)
    shard = token_files.Shard(token_files.pack(ids, [1, None], np.array([0, 5, len(ids)])))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [1, None]
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    some = draw.integers(0, len(ids), 5000)
    assert (shard.at(some) == ids[some]).all() and len(shard.at(np.zeros(0, np.int64))) == 0
    empty = token_files.Shard(token_files.pack(np.zeros(0, np.uint32), [7], np.array([0, 0])))
    assert len(empty.tokens()) == 0


def test_files_hold_documents_in_order(spark):
    ids = [50, 3, 7, 11, None, 2, 40, 40]
    rows = spark.createDataFrame(list(zip(ids, TEXTS, ["x"] * 8)), "doc_id long, text string, payload string").repartition(3)
    got = token_files.read_shards(token_files.write_shards(rows, PATH)).orderBy(F.col("start")).collect()
    order = sorted(range(8), key=lambda i: (ids[i] is not None, ids[i] or 0))
    assert [r["doc_id"] for r in got] == [ids[i] for i in order]
    start = 0
    for r, i in zip(got, order):
        want = np.array([*whole(TEXTS[i]), 1], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_shards(token_files.write_shards(rows, PATH)).collect() == []


def test_lookup_equals_bulk_reads(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 40_000)
    rows = spark.createDataFrame([(10 * i, t) for i, t in enumerate(TEXTS)] + [(30, "once more"), (None, "no id")], "doc_id long, text string").repartition(3)
    shards = token_files.write_shards(rows, PATH)
    by = {10 * i: [whole(t) + [1]] for i, t in enumerate(TEXTS)}
    by[30].append(whole("once more") + [1])
    draw = np.random.default_rng(2)
    asked = [(int(d), int(p)) for d in [*by, 999] for p in [0, 1, 29_999, 60_000, *draw.integers(0, 40_000, 20)]] + [(0, -1), (0, None), (None, 0), (0, 0), (0, 0)]
    got = token_files.lookup(shards, spark.createDataFrame([(*a, "x") for a in asked], "doc_id long, position long, token string").repartition(4)).collect()
    want = []
    for d, p in asked:
        found = [x[p] for x in by.get(d, []) if p is not None and 0 <= p < len(x)]
        want += [(d, p, t) for t in found or [None]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
