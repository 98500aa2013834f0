"""Token ids of many texts, each distinct unit of them encoded once for each worker process."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gleaner.llm.words import Known, Words, ragged

#: Distinct units that a worker keeps, and bytes of them; beyond that it starts anew.
MOST_UNITS = 2_000_000
MOST_BYTES = 64 << 20
#: Units encoded at once: what a tokenizer returns for each is large until its ids are taken.
AT_ONCE = 16_384


class UnitCoder:
    """encode takes units as str and gives the ids of each. The ids of a text must be those of its units, in order. Units are known by
    their bytes, whole, so that the ids of a unit never depend on what a worker saw before."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = MOST_UNITS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(units)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return lengths, np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(lengths.sum()))

    def __call__(self, units: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        distinct, back = units.distinct()
        if len(self.known) + len(distinct.start) > self.most or len(self.known.bytes) > MOST_BYTES:
            self.clear()
        at, hashes = self.known.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            texts = [distinct.word(i).decode("utf-8", "replace") for i in new.tolist()]
            parts = [self._encoded(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
            lengths, ids = (np.concatenate(x) for x in zip(*parts))
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.add(distinct, hashes, new)
            self.starts = np.r_[self.starts, len(self.ids) + np.r_[0, np.cumsum(lengths)[:-1]]]
            self.lengths = np.r_[self.lengths, lengths]
            self.ids = np.r_[self.ids, ids]
        at = at[back]
        lengths = self.lengths[at]
        sums = np.r_[0, np.cumsum(lengths)]
        return self.ids[ragged(lengths, self.starts[at])], sums[units.first[1:]] - sums[units.first[:-1]]
