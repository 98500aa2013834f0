import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import collision_search, rabitq

SCHEMA = "vec_id long, embedding array<float>, extra string"


def near_copies(n, seed, size=24):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, size))
    copies = base[draw.integers(0, n, n)] + 0.08 * draw.standard_normal((n, size))
    crowd = base[0] + 0.05 * draw.standard_normal((n // 2, size))
    return np.r_[base, copies, crowd, base[:5]].astype(np.float32)


def links(x, threshold):
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    return near.sum(1).tolist(), root


@pytest.mark.parametrize("block", [1000, 20])
def test_near_duplicates_equal_brute_force(spark, block):
    x = near_copies(120, 5)
    rows = spark.createDataFrame([(i * 3, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = {r["vec_id"]: r for r in rabitq.near_duplicates(rows, 0.9, block=block).collect()}
    n, root = links(x, 0.9)
    assert len(got) == len(x)
    assert [got[i * 3]["n_links"] for i in range(len(x))] == n
    assert [got[i * 3]["component_id"] for i in range(len(x))] == [r * 3 for r in root]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


ODD = [
    (1, [1.0, 0.0, 0.0], ""), (2, [1.0, 0.01, 0.0], ""), (3, None, ""), (4, [0.0, 0.0, 0.0], ""), (5, [1.0, None, 0.0], ""), (6, [float("nan"), 0.0, 0.0], ""),
    (7, [float("inf"), 0.0, 0.0], ""), (8, [1.0, 0.0], ""), (None, [1.0, 0.0, 0.0], ""), (9, [1e-30, 0.0, 0.0], ""), (10, [], ""),
]


@pytest.mark.parametrize("miss", [rabitq.MISS, 0])
def test_thousands_of_links(spark, miss):
    """Chains and crowds of near copies, exact copies among them; with miss=0 not one link is left out."""
    draw = np.random.default_rng(15)
    x = draw.standard_normal((40, 64))[draw.integers(0, 40, 1500)] + draw.choice([0.05, 0.3, 0.36], (1500, 1)) * draw.standard_normal((1500, 64))
    x = np.r_[x, x[draw.integers(0, 1500, 200)], np.repeat(x[:1], 300, 0)].astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = {r["vec_id"]: r for r in rabitq.near_duplicates(rows, 0.9, miss=miss, block=300).collect()}
    n, root = links(x, 0.9)
    assert sum(n) > 20_000
    if not miss:
        assert [got[i]["n_links"] for i in range(len(x))] == n
        assert [got[i]["component_id"] for i in range(len(x))] == root
    else:
        assert all(got[i]["n_links"] <= n[i] for i in range(len(x))) and sum(r["n_links"] for r in got.values()) >= 0.99 * sum(n)


def test_vectors_that_link_with_nothing(spark):
    got = rabitq.near_duplicates(spark.createDataFrame(ODD, SCHEMA), 0.9).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(ODD)
    assert by == {1: (2, 1), 2: (2, 1), 9: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 10: (0, 10), None: (0, None)}


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (2, [1.0, 0.0], ""), (2, [0.0, 1.0], "")], SCHEMA)
    got = rabitq.near_duplicates(rows, 0.9).collect()
    assert sorted((r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in got) == [(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (2, 2, 0, True)]
    assert rabitq.near_duplicates(spark.createDataFrame([], SCHEMA), 0.9).collect() == []


def test_estimates_are_unbiased_and_their_spread_is_as_stated():
    draw = np.random.default_rng(8)
    a = rabitq.unit(draw.standard_normal((4000, 64)))
    b = rabitq.unit(a + 0.06 * draw.standard_normal((4000, 64)))
    _, signs, factor = rabitq.codes(a)
    turned, _, _ = rabitq.codes(b)
    estimate = (signs * turned).sum(1) / (8 * factor)
    true = (a * b).sum(1)
    spread = np.sqrt((1 - factor**2) / (factor**2 * 63) * (1 - true**2))
    off = (estimate - true) / spread
    assert abs(off.mean()) < 0.06 and 0.9 < off.std() < 1.1


def test_recall_at_the_threshold_itself():
    """Pairs just at the threshold, over a table of the size the keys are made for."""
    draw = np.random.default_rng(9)
    bits, tables = rabitq.shape(50_000, 0.9)
    a = rabitq.unit(draw.standard_normal((3000, 64)))
    c = draw.standard_normal((3000, 64))
    c -= (c * a).sum(1, keepdims=True) * a
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * c / np.sqrt((c * c).sum(1, keepdims=True))
    shared = (rabitq._keys(a, bits, tables) == rabitq._keys(b, bits, tables)).any(1)
    assert shared.mean() > 0.975


def test_search_against_brute_force(spark):
    x = near_copies(400, 6)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = collision_search.search(rows, F.col("vec_id") % 20 == 0, block=300).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert set(by) == set(range(0, len(x), 20))
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert np.allclose([s for _, _, s in found], [d[v] for _, v, _ in found], rtol=1e-12, atol=0)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
        total += 10
    assert hits / total >= 0.95


def test_few_vectors_are_verified(spark):
    """Clustered vectors, in two blocks: the collision threshold keeps most from exact distances, at a recall of nine tenths or more."""
    draw = np.random.default_rng(12)
    centres = draw.standard_normal((60, 64))
    x = (centres[draw.integers(0, 60, 6000)] + 0.4 * draw.standard_normal((6000, 64))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    got = collision_search.search(rows, F.col("vec_id") % 100 == 0, block=3000, verified=True).collect()
    share = {r["query_id"]: r["verified"] / (len(x) - 1) for r in got}
    assert len(share) == 60 and 0 < sum(share.values()) / 60 < 0.2
    hits = 0
    for q in share:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_search_odd_vectors_ties_and_few_candidates(spark):
    rows = spark.createDataFrame([*ODD, (100, [1.0, 0.0, 0.0], ""), (200, [1.0, 0.0, 0.0], ""), (200, [1.0, 0.0, 0.0], ""), (300, None, "")], SCHEMA)
    got = collision_search.search(rows, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {100: [1, 200, 2, 9], 200: [1, 100, 2, 9]}
    assert collision_search.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert collision_search.search(rows, F.col("vec_id") == -1).collect() == []
