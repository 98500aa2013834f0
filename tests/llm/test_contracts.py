"""The queries themselves over small tables of awkward rows, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from gleaner.llm import mixing, queries

SPACES = bytes([32, *range(9, 14)])


def words(text):
    out, word = [], bytearray()
    for b in text.encode("utf-8", "surrogatepass") + b" ":
        if b in SPACES:
            if word:
                out.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    return out


def documents():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randint(1, 6))) for _ in range(150)]
    passage = " ".join(draw.choices(vocabulary, k=40))
    rows = []
    for i in range(120):
        body = " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 60, 200])))
        rows.append((f"{body} {passage} {draw.choice(vocabulary)}" if i % 3 == 0 else body, draw.choice(["hot", "hot", "b", "c", None])))
    rows += [(rows[0][0], "hot"), (rows[3][0] + " x", "b"), ("w a \u2028", "b"), ("\u2029", "b"), ("a\u0085", "b"), ("\x85 \x1c x", "b"), (None, "b"), ("", None), (" \n", "c"), ("x" * 70_000, "c"), ("w z " * 9000, "c")]
    ids = draw.sample(range(10_000), len(rows))
    return [(i, t, draw.choice(["en", "de", None]), s, None if t is None else len(t)) for i, (t, s) in zip(ids, rows)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = documents()
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))]
    pq.write_table(pa.table(columns, names=["doc_id", "text", "lang", "source", "n_chars"]), path / "documents.parquet")
    draw = np.random.default_rng(3)
    x = draw.standard_normal((60, 16))[draw.integers(0, 60, 400)] + 0.1 * draw.standard_normal((400, 16))
    vectors = [*x.astype(np.float32).tolist(), None, [0.0] * 16, [float("nan")] * 16, [1.0] * 8 + [None] * 8]
    pq.write_table(pa.table([pa.array([10 * i for i in range(len(vectors))], pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], names=["vec_id", "embedding"]), path / "embeddings.parquet")
    return str(path), rows, {10 * i: np.array(v, dtype=float) for i, v in enumerate(vectors[:400])}


def test_op1(spark, tables):
    path, _, vectors = tables
    got = {r["vec_id"]: r for r in queries.op1_embedding_near_dedup(spark, path).collect()}
    ids = list(vectors)
    u = np.stack(list(vectors.values()))
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert len(got) == 404 and all(got[i]["n_links"] == near[k].sum() - 1 for k, i in enumerate(ids))
    assert near.sum() > 2000 and all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(4000, 4040, 10))
    root = np.arange(400)
    while True:
        new = np.array([root[near[k]].min() for k in range(400)])
        if (new == root).all():
            break
        root = new
    assert all(got[i]["component_id"] == ids[root[k]] and got[i]["kept"] == (root[k] == k) for k, i in enumerate(ids))


def test_op2(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op2_mixing(spark, path).collect()}
    size = {i: len(words(t or "")) for i, t, *_ in rows}
    sums = {}
    for i, _, _, s, _ in rows:
        sums[s] = sums.get(s, 0) + size[i]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sums[s] for s in names], (5, 2, 1, 5), 1.5 * sum(sums.values()))))
    took = dict.fromkeys(names, 0)
    for i, _, _, s, _ in rows:
        assert (got[i]["size"], got[i]["source_size"]) == (size[i], sums[s]) and got[i]["target"] == pytest.approx(want[s])
        assert 0 <= got[i]["taken"] <= 2 * size[i]
        took[s] += got[i]["taken"]
    assert all(abs(took[s] - want[s]) <= 3 * mixing.BLOCK for s in names)


def test_op3(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, path).collect()}
    tokenizer, start = Tokenizer.from_file(queries.WORD_BPE), 0
    for i, t, *_ in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op6_language(spark, path).collect()}
    for i, t, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
        assert got[i]["lang_pred"] in ("und", "en", "de") and 0 <= got[i]["score"] <= 1


def test_op7(spark, tables):
    path, _, vectors = tables
    got = {}
    for r in queries.op7_nearest(spark, path).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = {i: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for i, v in vectors.items() if i != q}
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v in sorted((s, v) for v, s in d.items())[:10]})
    assert hits >= 9 * len(got)


def test_op8(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, path).collect()}
    prints = {}
    for i, t, *_ in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    root = {i: i for i in prints}
    while True:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == root:
            break
        root = new
    assert {i: got[i]["component_id"] for i in prints} == root


def test_op9(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op9_pieces(spark, path).collect()}
    assert len(got) == len(rows) and all(r["round_trip"] and r["parity"] and r["n_pieces"] == len(r["piece_ids"]) for r in got.values())


def test_op10(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in queries.op10_substring_dedup(spark, path).collect()}
    first = {}
    split = {i: words(t or "") for i, t, *_ in rows}
    for i, w in split.items():
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    removed = 0
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        removed += sum(gone)
    assert removed > 1000
