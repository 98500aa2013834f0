"""Collocations against a count of all phrases."""

import random
import re
from collections import Counter

import pytest

from gleaner.llm import collocations

SCHEMA = "lang string, text string"


def brute(rows, least, longest=4, most=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) and 100 * a >= 80 * f[lang, p[i:j]]:
                    gone.add((lang, p[i:j]))
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) in gone:
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:most], 1))


def made(seed, n=300):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "aé", " ", "x" * 40, "x" * 39 + "y", *("w%d" % i for i in range(40))]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(draw.choice([0, 1, 20, 80])):
            parts.append(draw.choice(["New York city hall", "NEW  york", "a a a a a", "of\tthe", *words]))
        rows.append((draw.choice(["en", "en", "en", "de", None, "und", ""]), "".join(p + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r"]) for p in parts)))
    return [*rows, ("en", None), (None, ""), ("en", " . ,"), ("de", "only once"), ("fr", "b c " * 20_000), ("en", "q" * 200_000)]


@pytest.mark.parametrize("seed,least,chunk,groups", [(1, 5, 8 << 20, 96), (2, 12, 2000, 7), (3, 1, 700, 3)])
def test_phrases_equal_brute_force(spark, seed, least, chunk, groups):
    rows = made(seed, 300 if least > 1 else 60)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least, chunk_bytes=chunk, fewest_groups=groups)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_fewer_ranks_and_nothing(spark):
    rows = made(4)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), 5, most=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, most=3)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None)], SCHEMA), 1).count() == 0
    named = spark.createDataFrame([("en", "a b a b", 1, "x")], SCHEMA + ", Lang int, TEXT string")
    assert sorted(map(tuple, collocations.collocations(named, 2).collect())) == brute([("en", "a b a b")], 2)
