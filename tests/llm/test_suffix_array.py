import random

import numpy as np
import pytest

from gleaner.llm.suffix_array import common_prefixes, suffix_array


def strings():
    draw = random.Random(7)
    out = [b"", b"a", b"aaaa", b"abab", b"mississippi", b"\x00\x00", b"\xff" * 300, bytes(range(256)) * 3, b"ab" * 200 + b"a", b"ba" * 201]
    for n, alphabet in ((50, b"ab"), (500, b"ab"), (3000, b"abc\x00\xff"), (2000, bytes(range(256)))):
        out += [bytes(draw.choices(alphabet, k=n)) for _ in range(6)]
    part = bytes(draw.choices(b"abcdef ", k=700))
    return [*out, part * 3 + b"x" + part[100:] + part[:350]]


@pytest.mark.parametrize("text", strings())
def test_order_and_common_prefixes(text):
    x = np.frombuffer(text, dtype=np.uint8)
    got = suffix_array(x)
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    if not text:
        return
    draw = np.random.default_rng(len(text))
    room = np.minimum(draw.integers(0, 500, len(text)), len(text) - np.arange(len(text)))
    room = np.maximum.accumulate((room + np.arange(len(text)))) - np.arange(len(text))  # ends do not go back
    room = np.minimum(room, len(text) - np.arange(len(text)))
    shared = common_prefixes(x, got, room)
    for a, b in zip(got, got[1:]):
        k = 0
        while k < min(room[a], room[b]) and text[a + k] == text[b + k]:
            k += 1
        assert shared[b] == k


@pytest.mark.parametrize("text", strings()[-6:])
def test_with_a_depth_what_agrees_so_far_is_together(text):
    x = np.frombuffer(text, dtype=np.uint8)
    got = suffix_array(x, 40)
    assert sorted(got.tolist()) == list(range(len(text)))
    keys = [text[i : i + 40] for i in got]
    assert keys == sorted(keys)
