"""Suffix arrays of byte strings by induced sorting, with numpy, and their permuted common prefixes.

Suffixes are of type S or L, as they are smaller or larger than the next one. The substrings between leftmost S suffixes are sorted by
induction and named, and the string of names, a third as long, is sorted by naming pairs of names again and again. From these suffixes all others are
induced in two sweeps over the buckets of first bytes: a bucket is filled from smaller ones, or larger ones, and from itself where a
byte repeats, so every sweep moves whole arrays and takes linear time.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the end is smaller than any byte."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n > 1:
        differ = np.flatnonzero(text[:-1] != text[1:])
        if len(differ):  # a run of one byte is of its last place's type
            out[: differ[-1] + 1] = np.repeat(text[differ] < text[differ + 1], np.diff(differ, prepend=-1))
    return out


def _by_byte(found: np.ndarray, text: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends suffixes to the buckets of their first bytes, in their order."""
    if not len(found):
        return
    first = text[found]
    order = np.argsort(first, kind="stable")
    own, moved = first[order], found[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
        into[own[a]].append(moved[a:b])


def _bucket(parts: list[np.ndarray], text: np.ndarray, byte: int) -> np.ndarray:
    """A bucket's suffixes of one type, with those that a run of the byte adds, wave by wave."""
    wave = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    out = [wave]
    while len(wave):
        wave = wave[wave > 0] - 1
        wave = wave[text[wave] == byte]
        out.append(wave)
    return np.concatenate(out)


def _induced(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as the leftmost S suffixes are: seeds has these in order."""
    n = len(text)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    seeded: list[list[np.ndarray]] = [[] for _ in range(256)]
    _by_byte(seeds, text, seeded)
    large[text[n - 1]].append(np.array([n - 1], dtype=np.int32))
    larges: list[np.ndarray] = []
    for byte in range(256):
        own = _bucket(large[byte], text, byte)
        larges.append(own)
        before = np.concatenate([own, *seeded[byte]])
        before = before[before > 0] - 1
        _by_byte(before[text[before] > byte], text, large)
    smalls: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * 256
    for byte in range(255, -1, -1):
        own = _bucket(small[byte], text, byte)  # from the last to the first
        smalls[byte] = own[::-1]
        before = np.concatenate([own, larges[byte][::-1]])
        before = before[before > 0] - 1
        _by_byte(before[text[before] < byte], text, small)
    return np.concatenate([x for byte in range(256) for x in (larges[byte], smalls[byte])])


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b, of equal length each, are equal."""
    equal = np.ones(len(a), dtype=bool)
    left = np.arange(len(a))
    step = 0
    while len(left):
        at = left
        same = text[a[at] + step] == text[b[at] + step]
        equal[at[~same]] = False
        step += 1
        left = at[same & (length[at] > step)]
    return equal


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of a byte array in order. With a depth, those that agree in so many bytes are neighbours, in any order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    small = _types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(leftmost):
        return _induced(text, leftmost)
    # Their substrings, each up to and with the next one's first byte, in order of induction; equal neighbours get one name.
    marked = np.zeros(n, dtype=bool)
    marked[leftmost] = True
    order = _induced(text, leftmost)
    order = order[marked[order]]
    end = np.empty(n, dtype=np.int32)
    end[leftmost] = np.r_[leftmost[1:] + 1, n]
    length = end[order] - order
    equal = np.zeros(len(order), dtype=bool)
    close = np.flatnonzero(length[1:] == length[:-1])
    # The last one ends the text, and what ends there is smaller than what goes on.
    close = close[(order[close] != leftmost[-1]) & (order[close + 1] != leftmost[-1])]
    equal[close + 1] = _same(text, order[close], order[close + 1], length[close + 1])
    number = np.empty(n, dtype=np.int32)
    number[leftmost] = np.arange(len(leftmost), dtype=np.int32)
    return _induced(text, leftmost[_sorted_names(number[order], ~equal, depth)])


def _sorted_names(order: np.ndarray, start: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffixes of a string of names in order, by names of pairs, of pairs of pairs, and so on; what is told apart stays so.

    order: these by their first names alone; start: where in it each name starts. A name is the first place of its class in the order, from 1.
    """
    m, width = len(order), 1
    name = np.empty(m, dtype=np.int32)
    name[order] = (np.flatnonzero(start) + 1).astype(np.int32)[np.cumsum(start) - 1]
    # Two bytes a name at least: with a depth, so many names are enough.
    enough = m if depth is None else depth // 2 + 1
    bits = m.bit_length()
    open_ = np.arange(m)  # places in the order whose class has others
    while True:
        open_ = open_[~(start & np.r_[start[1:], True])]
        if width >= enough or not len(open_):
            return order
        at = order[open_]
        own = name[at].astype(np.uint64)
        follows = at.astype(np.int64) + width
        after = np.where(follows < m, name[np.minimum(follows, m - 1)], 0).astype(np.uint64)
        # Within its class, which is a range of the order, each goes by what follows.
        if 3 * bits <= 64:  # its number fits in too: values are sorted faster than their places
            low = np.uint64(bits)
            key = np.sort(((own << low) | after) << low | np.arange(len(at), dtype=np.uint64))
            at = at[(key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
            key >>= low
        else:
            key = (own << np.uint64(32)) | after
            again = np.argsort(key)
            at, key = at[again], key[again]
        order[open_] = at
        start = np.r_[True, key[1:] != key[:-1]]
        name[at] = (open_[start] + 1).astype(np.int32)[np.cumsum(start) - 1]
        width *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each suffix in order, which may leave out some, by its place in the text, how many bytes it shares with the suffix before it in
    order; neither looks further than its room. Nothing for those left out.

    Where a suffix and its neighbour both come right after a suffix and its neighbour, one byte less is shared; only the others are compared.
    """
    n = len(text)
    all_before = np.full(n, -2, dtype=np.int32)
    all_before[order[1:]] = order[:-1]
    all_before[order[:1]] = -1
    place = np.flatnonzero(all_before > -2)
    before = all_before[place].astype(np.int64)
    most = np.where(before >= 0, np.minimum(room[place], room[before]), 0)
    follows = np.zeros(len(place), dtype=bool)
    follows[1:] = (place[1:] == place[:-1] + 1) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (text[place[:-1]] == text[before[:-1]])
    run = np.cumsum(~follows) - 1
    first = np.flatnonzero(~follows)
    heads, others = place[first], before[first]
    # A head is compared as far as any of those that follow it may look.
    reach = np.maximum.reduceat(most + (place - heads[run]), first) if len(place) else most
    words = _eights(text)
    open_, step = np.flatnonzero(others >= 0), 0
    got = np.zeros(len(heads), dtype=np.int64)
    while len(open_):
        a, b = heads[open_] + step, others[open_] + step
        inside = (a < n) & (b < n)
        differ = np.ones(len(open_), dtype=np.uint64)
        differ[inside] = words[a[inside]] ^ words[b[inside]]
        same = differ == 0
        end = open_[~same]
        low = differ[~same]
        # The lowest byte that differs, by its lowest bit: a power of two is exact as a float.
        with np.errstate(over="ignore"):
            byte = np.log2((low & (np.uint64(0) - low)).astype(np.float64)).astype(np.int64) // 8
        got[end] = step + np.where(inside[~same], byte, 0)
        step += 8
        got[open_[same]] = step
        open_ = open_[same]
        open_ = open_[reach[open_] > step]
    shared = got[run] - (place - heads[run])
    # Beyond a head's own end nothing is known to be shared.
    out = np.zeros(n, dtype=np.int64)
    out[place] = np.minimum(np.maximum(shared, 0), most)
    return out


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, the first one lowest; zeros past the end."""
    padded = np.r_[text, np.zeros(8, dtype=np.uint8)].astype(np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view("<u8").ravel()
