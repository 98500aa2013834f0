import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import suffixes


def by_hand(rows, depth):
    """For each row its words and which stay."""
    none = float("inf")
    first = {}
    split = [(none if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - depth + 1):
            key = tuple(w[k : k + depth])
            first[key] = min(first.get(key, none), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - depth + 1):
            if first[tuple(w[k : k + depth])] < d:
                gone[k : k + depth] = [True] * depth
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdé", k=draw.randint(1, 4))) for _ in range(60)]
    passages = [draw.choices(words, k=draw.randint(10, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = draw.choices(words, k=draw.randint(0, 80))
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(w))
            w[at:at] = draw.choice(passages)
        texts.append(draw.choice([" ", "\n", "  \t"]).join(w) + draw.choice(["", " ", "\n"]))
    texts += draw.choices(texts, k=10) + ["the same words " * 40] * 3 + ["", None, "  ", "a b c", "x" * 3000]
    ids = draw.sample(range(1000), len(texts))
    ids[3] = ids[7]
    ids[-2] = ids[5] = None
    return list(zip(ids, texts))


@pytest.mark.parametrize(("depth", "group", "chunk", "fan_in"), [(13, 200_000, 8 << 20, 4096), (13, 50, 700, 4096), (4, 20, 2000, 2)])
def test_equals_brute_force(spark, monkeypatch, depth, group, chunk, fan_in):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    rows = corpus(depth + group)
    table = spark.createDataFrame([(i, d, t, "w", 1.5) for i, (d, t) in enumerate(rows)], "at long, doc_id long, text string, n_words string, data double").repartition(4)
    got = suffixes.remove_repeats(table, depth, group, fan_in)
    assert sorted(got.columns) == ["at", "data", "doc_id", "n_removed", "n_words", "text"]
    got = {r["at"]: r for r in got.collect()}
    want = by_hand(rows, depth)
    assert len(got) == len(rows)
    for i, (n, gone, kept) in enumerate(want):
        r = got[i]
        assert (r["n_words"], r["n_removed"], " ".join(x.decode() for x in (r["text"] or "").encode().split())) == (n, gone, kept), i
        assert r["doc_id"] == rows[i][0] and r["data"] == 1.5
        if not gone:
            assert r["text"] == rows[i][1]
    assert sum(g for _, g, _ in want) > 100


def test_payloads_pack_and_unpack():
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (suffixes._unpack_sorted(suffixes._pack_sorted(values)) == values).all()
    for words in (50, 70_000):
        names = pa.array([b"w%d" % i for i in range(words)] + [b"", b"\xff"], pa.binary())
        rows = np.r_[draw.integers(0, words + 2, (words, 5)), np.arange(101)[:, None] % 50 + np.arange(5)]
        rows[words + 50] = rows[words + 49] + 1
        rows[words + 51 :] = rows[words + 50] + np.arange(1, 51)[:, None]
        rows %= words + 2
        for docs in (draw.integers(-(2**63), 2**63, words + 101), np.full(words + 101, 2**63 - 1)):
            got = suffixes.Suffixes.unpack(suffixes.Suffixes(names, rows, docs).pack())
            follows = np.r_[False, (rows[1:, :-1] == rows[:-1, 1:]).all(1) & (docs[1:] == docs[:-1])]
            again = suffixes.Suffixes.unpack(suffixes.Suffixes(names, rows, docs).pack(follows))
            assert (again.rows == got.rows).all() and (again.docs == docs).all() and follows.sum() == (100 if (docs == docs[0]).all() else 0)
            assert (got.docs == docs).all() and [[got.words[int(i)].as_py() for i in r] for r in got.rows[-20:]] == [[names[int(i)].as_py() for i in r] for r in rows[-20:]]


def test_subtrees_sort_suffixes_by_their_words():
    draw = random.Random(3)
    lists = [[[draw.choice([b"a", b"ab", b"b", b"", b"\xc3"]) for _ in range(3)] for _ in range(40)] for _ in range(3)]
    parts = []
    for rows in lists:
        names = sorted({w for r in rows for w in r}, key=lambda w: (len(w), w))
        parts.append(suffixes.Suffixes(pa.array(names, pa.binary()), np.array([[names.index(w) for w in r] for r in rows]), np.arange(len(rows))))
    every = suffixes.Suffixes.union(parts)
    order, starts = every.tree()
    flat = [r for rows in lists for r in rows]
    assert [flat[i] for i in order] == sorted(flat)
    assert [flat[order[i]] for i in starts] == sorted({tuple(r): r for r in flat}.values())


def test_equal_hashes_are_no_repeats(spark, monkeypatch):
    """Even if all signatures and labels were equal, only equal words would go."""
    real = suffixes.windows
    monkeypatch.setattr(suffixes, "windows", lambda h, n, size: (lambda x, at: (x & np.uint64(3) << np.uint64(62), at))(*real(h, n, size)))
    rows = corpus(5)
    chunks = [pa.table({"doc_id": pa.array([d for d, _ in part], pa.int64()), "text": pa.array([None if t is None else t.encode() for _, t in part], pa.binary())}) for part in (rows[:40], rows[40:])]
    read = [suffixes._Chunk(t, 13) for t in chunks]
    base, ways = np.zeros(suffixes._BINS, np.int64), np.ones(suffixes._BINS, np.int64)
    for c in read:
        assert len(c.labels) <= 4
        c.ask(np.ones(len(c.labels), bool), base, ways)
    sizes, _, bits, _ = suffixes._subtree([c.suffixes(0, len(c.groups)).pack() for c in read])
    want = by_hand(rows, 13)
    got = []
    for c, own in zip(read, np.split(bits, np.cumsum(sizes)[:-1])):
        got += suffixes._cut(c, {0: np.packbits(own).tobytes()}, False).column("n_removed").to_pylist()
    assert got == [g for _, g, _ in want]


def test_bytes_that_are_no_utf8_and_spans(spark):
    passage = b" ".join(b"\xff%d" % i for i in range(15))
    rows = [(1, b"\x80 " + passage + b" end\xe2\x80"), (2, b"start " + passage + b"\n" + passage), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text", "cast(x'ff' as string) as other")
    out = suffixes.remove_repeats(table, spans=True)
    assert dict(out.dtypes)["text"] == "string"
    got = {r["doc_id"]: r for r in out.selectExpr("doc_id", "cast(text as binary) as t", "hex(other) as o", "n_words", "n_removed", "spans").collect()}
    assert (bytes(got[1]["t"]), got[1]["n_removed"], got[1]["o"]) == (rows[0][1], 0, "FF")
    assert (bytes(got[2]["t"]), got[2]["n_words"], got[2]["n_removed"]) == (b"start ", 31, 30)
    assert [tuple(x) for x in got[2]["spans"]] == [(1, 30)] and got[3]["t"] is None


def test_empty_and_short_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert sorted(map(tuple, suffixes.remove_repeats(one).collect())) == [(1, "a b", 2, 0), (2, None, 0, 0)]


@pytest.mark.parametrize("fan_in", [4096, 3])
def test_a_very_common_passage(spark, monkeypatch, fan_in):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"head{i} {passage} tail{i}") for i in range(400)]
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 4000)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), group_suffixes=50, fan_in=fan_in).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 60 if i else 0 for i in range(400)}
    assert all(r["text"] == f"head{r['doc_id']} tail{r['doc_id']}" for r in got if r["doc_id"])
