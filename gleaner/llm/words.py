"""Words of many texts at once, with numpy over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 1 << 16


def _table(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(_STEP - 1, base, dtype=np.uint64)], dtype=np.uint64)


_POWER, _BACK = _table(_BASE), _table(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    buffer: np.ndarray  # all texts, a space after each
    start: np.ndarray  # of each word in buffer
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial in its bytes, mixed with its length."""
        # Sums of powers restart at each step of the buffer, so memory follows the step; a word that crosses steps adds up its parts.
        out = np.zeros(len(self.start), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, at in enumerate(range(0, len(self.buffer), _STEP)):
                part = self.buffer[at : at + _STEP]
                a, b = np.searchsorted(self.end, at, "right"), np.searchsorted(self.start, at + len(part))
                if a == b:
                    continue
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
                low = np.maximum(self.start[a:b] - at, 0)
                high = np.minimum(self.end[a:b] - at, len(part))
                value = (sums[high] - sums[low]) * _BACK[low]
                if self.start[a] < at:  # its bytes before this step
                    value[0] *= np.uint64(pow(_BASE, int(at - self.start[a]), 2**64))
                out[a:b] += value
            return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def array(self) -> pa.Array:
        """All words by their bytes, one after the other."""
        edge = np.zeros(len(self.buffer) + 1, dtype=np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        offsets = np.r_[0, np.cumsum(self.end - self.start)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.buffer[inside].tobytes())])

    def distinct(self) -> tuple[Words, np.ndarray]:
        """The distinct words, told apart by their bytes, as one text, and the number of each word's."""
        coded = self.array().dictionary_encode()
        kinds = coded.dictionary
        ends = np.frombuffer(kinds.buffers()[1], dtype=np.int32)[kinds.offset : kinds.offset + len(kinds) + 1].astype(np.int64) if len(kinds) else np.zeros(1, np.int64)
        buffer = np.frombuffer(kinds.buffers()[2], dtype=np.uint8) if len(kinds) else np.zeros(0, dtype=np.uint8)
        return Words(buffer, ends[:-1], ends[1:], np.array([0, len(kinds)])), coded.indices.to_numpy().astype(np.int64)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]].tobytes()


class Known:
    """Rows of words, found by a hash and held against the words' bytes: a word whose hash another one has is not kept, so never mistaken."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)  # in bytes, of each row
        self.lengths = np.zeros(0, dtype=np.int64)
        self.bytes = np.zeros(0, dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.lengths)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, or -1, and the words' hashes."""
        hashes, length = words.hashes(), words.end - words.start
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.keys) and len(hashes):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            row = self.rows[at]
            hit = np.flatnonzero((self.keys[at] == hashes) & (self.lengths[row] == length))
            many = length[hit]
            same = words.buffer[ragged(many, words.start[hit])] == self.bytes[ragged(many, self.starts[row[hit]])]
            equal = np.logical_and.reduceat(same, np.cumsum(many) - many) if len(hit) else same
            out[hit[equal]] = row[hit[equal]]
        return out, hashes

    def add(self, words: Words, hashes: np.ndarray, which: np.ndarray) -> None:
        """Gives the words `which` the next rows, in order. Of words with one hash the first is found again."""
        first, length = len(self), words.end[which] - words.start[which]
        self.starts = np.r_[self.starts, len(self.bytes) + np.cumsum(length) - length]
        self.lengths = np.r_[self.lengths, length]
        self.bytes = np.r_[self.bytes, words.buffer[ragged(length, words.start[which])]]
        keys, one = np.unique(hashes[which], return_index=True)
        at = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        self.keys, self.rows = np.insert(self.keys, at[new], keys[new]), np.insert(self.rows, at[new], first + one[new])


def words_of(texts: list[bytes]) -> Words:
    joined = b" ".join(texts) + b" "
    buffer = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[buffer]
    # A word starts where a space, or nothing, comes before.
    change = np.flatnonzero(np.diff(space, prepend=True))
    start, end = change[0::2], change[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    first = np.r_[0, np.searchsorted(start, ends)].astype(np.int64)
    return Words(buffer, start, end, first)


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes unchanged."""
    return _LOWER[buffer]


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of size words, and the index of its first word; windows stay within a text."""
    with np.errstate(over="ignore"):
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out *= np.uint64(_BASE)
            out += hashes[j : n + j]
        ends = np.repeat(np.cumsum(counts), counts)
        at = np.flatnonzero(np.arange(n) + size <= ends[:n])
        return mix(out[at]), at


def slices(texts: list[bytes], most: int = 2 << 20) -> Iterator[slice]:
    """Ranges of texts of about most bytes, so that a batch of long texts takes bounded memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of each of many ranges, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offset = np.repeat(np.asarray(starts, dtype=np.int64) - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return np.arange(total, dtype=np.int64) + offset
