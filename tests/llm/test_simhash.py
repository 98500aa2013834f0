import random

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash
from gleaner.sources import scratch

SCHEMA = "doc_id long, text string, fp string"


def by_hand(text, shingle):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        counts += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def groups(ids, prints):
    root = list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    for _ in range(len(ids)):
        changed = False
        for n, i in enumerate(order):
            for j in order[:n]:
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and root[i] != root[j]:
                    a, b = sorted((root[i], root[j]), key=order.index)
                    root = [a if r == b else r for r in root]
                    changed = True
        if not changed:
            break
    return [ids[r] for r in root]


def texts(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdef", k=draw.randint(1, 5))) for _ in range(200)]
    base = [" ".join(draw.choices(words, k=draw.randint(1, 120))) for _ in range(25)]
    out = base + draw.choices(base, k=10)
    for t in base[:15]:  # near copies
        w = t.split()
        w[draw.randrange(len(w))] = draw.choice(words)
        out.append("\t".join(w))
    crowd = " ".join(draw.choices(words, k=400)).split()
    for i in range(30):
        out.append(" ".join([*crowd[:i], "Changed", *crowd[i + 1 :]]))
    return out + ["", None, " \n", "One", "one", "one two", "X" * 5000, "é É"]


@pytest.mark.parametrize(("shingle", "seed"), [(3, 1), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, shingle, seed):
    rows = texts(seed)
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA), shingle)
    got = got.select("doc_id", simhash.hexadecimal(got["fp"]).alias("h"), "component_id").orderBy("doc_id").collect()
    prints = [by_hand(t, shingle) for t in rows]
    assert [r["h"] for r in got] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in got] == groups(list(range(len(rows))), prints)


@pytest.mark.parametrize("hot", [1000, 3])
def test_links_with_and_without_finer_buckets(spark, hot):
    draw = np.random.default_rng(5)
    centres = draw.integers(0, 2**63, 20, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for k in (1, 2, 3, 4):
            for _ in range(4):
                prints.add(int(c) ^ sum(1 << int(b) for b in draw.choice(64, k, replace=False)))
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    rows = spark.createDataFrame([(p, p) for p in signed], "fp long, id long")
    edges = simhash.links(rows, hot=hot).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(at[e["a"]])] = find(at[e["b"]])
    want = list(range(len(prints)))

    def find_want(x):
        while want[x] != x:
            x = want[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                want[find_want(i)] = find_want(j)
    assert {frozenset(i for i in range(len(prints)) if find(i) == r) for r in map(find, range(len(prints)))} == {
        frozenset(i for i in range(len(prints)) if find_want(i) == r) for r in map(find_want, range(len(prints)))
    }


def test_pivots_discard_no_near_pair():
    draw = np.random.default_rng(6)
    prints = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    for i in range(500):
        prints[i + 500] = prints[i] ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, i % 6, replace=False)))
    a, b = simhash.pairs_within(np.zeros(3000, np.int64), prints, simhash.pivot_table(prints))
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(3000) for j in (np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1).tolist()}
    assert found == want and len(a) == len(found)
    a, b = simhash.pairs_within(np.arange(3000), prints, simhash.pivot_table(prints))
    assert len(a) == 0


def test_odd_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c d", ""), (5, "a b c d", ""), (5, "a b c d", ""), (None, "q r s t u", ""), (7, None, ""), (6, "", "")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 6), (6, 6)], key=str)
    kept = sorted((r["doc_id"] for r in simhash.keep_one(rows).collect()), key=str)
    assert kept == sorted([None, None, 5, 5, 6], key=str) and simhash.keep_one(rows).columns == rows.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def jaccard_groups(texts, shingle, similarity):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(seed, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(400)]
    out = []
    for k in range(n):
        base = draw.choices(words, k=draw.randint(80, 300))
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            w = list(base)
            for _ in range(draw.randint(1, 1 + len(w) // 60)):
                w[draw.randrange(len(w))] = draw.choice(words)
            out.append("\n".join(w))
        if k == 0:  # a crowd of near copies
            out += [" ".join([*base[:i], "Odd", *base[i + 1 :]]) for i in range(min(len(base), 80))]
    return [*out, *out[:3], "", None, "one", "ONE", "a b c d e f"]


@pytest.mark.parametrize(("block", "crowd"), [(1000, 20_000), (16, 8)])
def test_similar_texts_equal_brute_force(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SAMPLE", 1 if crowd < 100 else 16)
    rows = edited(9)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table).collect()}
    want = jaccard_groups(rows, 5, 0.8)
    assert len(got) == len(rows)
    wrong = [i for i, r in enumerate(want) if got[i] != r]
    split = [i for i in wrong if want[got[i]] == want[i]]
    assert wrong == split, "texts that are not alike were linked"
    assert len(split) <= 0.02 * len(rows), "links were missed"
    if not wrong:
        kept = sorted(r["doc_id"] for r in simhash.keep_one(table).collect())
        assert kept == sorted(set(want))


def test_similar_with_odd_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d", ""), (5, "a b c d", ""), (5, "a b c d", ""), (None, "q r s t u", ""), (7, None, ""), (6, "", "")], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 6), (6, 6)], key=str)
    assert simhash.similar(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_that_differ_only_in_repeats_are_linked(spark):
    draw = random.Random(4)
    rows = []
    for k in range(60):
        w = [f"{k}x{draw.random()}" for _ in range(104)]
        line = w[30:60]
        rows += [" ".join(w), " ".join([*w[:60], *line * 20, *w[60:]])]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table).collect()}
    want = jaccard_groups(rows, 5, 0.8)
    assert sum(want[i] != i for i in range(len(rows))) == 60
    missed = sum(got[i] != want[i] for i in range(len(rows)))
    assert missed <= 3, missed
    # Equal sets: no link may be missed.
    rows = [t for k in range(40) for w in [[f"{k}y{j}" for j in range(100)]] for t in (" ".join([*w, *w]), " ".join([*w, *w, *w, *w[:30]]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table).collect()}
    assert [got[i] for i in range(len(rows))] == [i - i % 2 for i in range(len(rows))]


def test_fingerprints_of_similar_texts_come_from_distinct_shingles():
    hashes = np.array([3, 1, 3, 3, 2, 7, 7], dtype=np.uint64)
    assert [x.tolist() for x in simhash._sets(hashes, np.array([5, 0, 2]))] == [[1, 2, 3], [], [7]]


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_texts_of_few_shingles_equal_brute_force(spark, similarity):
    few = simhash.few_shingles(similarity)
    assert simhash.few_shingles(0.8) == 14
    draw = random.Random(6)
    rows = ["", "a", "A"]
    for k in range(150):
        base = [f"{k}z{j}" for j in range(draw.randint(2, few + 4))]
        rows.append(" ".join(base))
        for _ in range(3):
            a, b = draw.randint(0, 1), len(base) - draw.randint(0, 2)
            rows.append(" ".join([*base[a:b], *[f"new{draw.random()}"] * draw.randint(0, 1)]))
    rows = [t for t in rows if len(t.split()) <= few + 4] + ["common one two three four five six seven eight nine " + x for x in ("", "p", "p q", "p q r", "s")]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table, similarity=similarity).collect()}
    assert [got[i] for i in range(len(rows))] == jaccard_groups(rows, 5, similarity)


def test_texts_without_ids_link_and_link_others(spark):
    """a - b - c are alike in a chain, of which only the middle has no id; d and e have none."""
    draw = random.Random(8)
    base = [f"w{draw.random()}" for _ in range(200)]
    a, b, c = (" ".join([*["new" + str(i) for i in range(k)], *base[k:]]) for k in (0, 16, 32))
    other = [f"v{i}" for i in range(120)]
    rows = [(1, a, ""), (None, b, ""), (9, c, ""), (None, " ".join(other), ""), (None, " ".join([*other, "end"]), "")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.similar(spark.createDataFrame(rows, SCHEMA), miss=1e-6).collect()]
    assert jaccard_groups([r[1] for r in rows], 5, 0.8) == [0, 0, 0, 3, 3]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (9, 1), (None, None), (None, None)], key=str)


def test_a_small_miss_asks_for_more_keys():
    shapes = [simhash.wide_shape(100_000, 0.8, miss) for miss in (0.02, 1e-4, 1e-8)]
    assert [s[0] for s in shapes] == sorted(s[0] for s in shapes) and shapes[0][2] < shapes[1][2] < shapes[2][2] and shapes[0][0] == 28


def test_texts_that_share_half_of_their_hash_are_two(spark):
    rows = [(4, 7, 1), (3, 7, 2), (2, 7, 2), (1, 8, 2), (None, 8, 2)]
    table = spark.createDataFrame([(*r, 5, 6, 9, b"") for r in rows], "doc_id long, text1 long, text2 long, fp long, fp2 long, size int, few binary")
    got = sorted(simhash.distinct_texts(table).select("text1", "text2", "doc_id", "node").collect())
    assert [tuple(r[:3]) for r in got] == [(7, 1, 4), (7, 2, 2), (8, 2, 1)]
    assert got[0]["node"] == 7 and got[2]["node"] == 8 and got[1]["node"] not in (7, 8)


def test_sets_held_against_many_others_equal_one_by_one():
    draw = np.random.default_rng(5)
    own = np.unique(draw.integers(0, 60, 40, dtype=np.uint64))
    others = [np.unique(draw.integers(0, 60, n, dtype=np.uint64)) for n in (0, 1, 30, 60, 200)] + [own]
    alike = [len(np.intersect1d(own, x)) >= 0.5 * len(np.union1d(own, x)) for x in others]
    assert simhash._similar_to(own, others, 0.5).tolist() == alike
    assert simhash._similar_to(own[:0], others, 0.5).tolist() == [True] + [False] * 5


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30)), None) for i in range(20)]
    out = simhash.similar(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 20
    assert sorted(x.name.rsplit("-", 1)[0] for x in (tmp_path / "gleaner").iterdir() if not x.name.startswith(".")) == ["fingerprints", "texts"]
