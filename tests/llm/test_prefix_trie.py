"""The prefix trie against a brute force over dictionaries of whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gleaner.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0], y[1], digest(y[1], y[2])))] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def made(seed, n=240):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(400), n):
        hot = c % 3 == 0
        for t in range(draw.choice([1, 2, 3, 12, 30])):
            text = f"same {t}" if hot and (t < 6 or draw.random() < 0.9) else draw.choice(["", None, "é" * draw.randint(0, 9), f"other {draw.randint(0, 3)}"])
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]) if not hot else "user", text))
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(0, 100, 5) for t in range(40)]  # copies, whole
    rows += [(2, 1, "user", "x" * 100_000), (2, 1, "user", "x" * 100_000), (None, 0, "user", "x"), (7777, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("group_turns,fewest", [(200_000, 4), (200_000, 256), (30, 8), (1, 3)])
def test_trie_equals_brute_force(spark, group_turns, fewest):
    rows = made(group_turns)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), group_turns, fewest)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_nothing_and_clashing_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, 0, "user", "a"), (6, 0, "user", "b")]
    named = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", Text string, Depth long, top string")
    assert sorted(map(tuple, prefix_trie.trie(named).collect())) == brute(rows)


def test_long_lists_of_ids_are_hashed_in_order(spark):
    ids = random.Random(1).sample(range(10**6), 9000)
    got = prefix_trie.ends(spark.createDataFrame([(b"p", i) for i in ids] + [(b"q", 7)], "prefix binary, conv_id long")).collect()
    want = {b"p": ",".join(map(str, sorted(ids))), b"q": "7"}
    assert {bytes(r["prefix"]): r["ends_sha256"] for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
