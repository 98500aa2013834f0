import random

import pytest

from gleaner.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    draw = random.Random(kind)
    edges = {
        "random": [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)],
        "path": [(i, i + 1) for i in range(150)],
        "star": [(1000, i) for i in range(150)],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
