"""Substring dedup by suffix trees over words, in groups.

Suffixes are word positions; trees are cut at DEPTH words, below which nothing is asked of them. A suffix whose first DEPTH words begin no
other is a leaf that hangs above that depth: a count of short signatures of those words, over all suffixes, finds these first, and they
are not sent on. The others go to groups that fit in memory, which a count over all suffixes plans. In its group every suffix has its
words; they are put in order word by word, and where neighbours share DEPTH words there is an internal node at that depth, with the
smallest document below it. Nodes at consecutive words of a text grow together into its repeated passages: see spans.

What parts the suffixes is told by their first DEPTH words: the least hash of the RUN-word runs among them, not how they begin. Neighbours
in a text mostly share it, so they go to one group as one stretch of text: about three words a suffix, where by their beginnings each would
need all its DEPTH. Where one such run is too common, all DEPTH words part its suffixes further.

Rows are packed into chunks once, whole, so that what the trees say can find its way back: each chunk sends each group its distinct
suffixes, with the smallest document of each, and gets one bit a suffix back. Chunks are dealt into sets of FAN_IN; where there
are several, each set is merged first, so that a passage that every chunk has reaches its group once a set, not once a chunk.
Signatures only spare work: two suffixes are one node only if their words are equal.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import apart, drop, materialize, small_batches
from gleaner.llm.held import forget, release, then_trim, trim
from gleaner.llm.words import Words, mix, ragged, windows, words_of

DEPTH = 13
#: Bytes of text in a chunk, and suffixes in a group, which bound what a task holds; and chunks that are merged before their group.
CHUNK_BYTES = 4 << 20
GROUP_SUFFIXES = 800_000
FAN_IN = 4096
FEWEST_GROUPS = 96
#: Bits of a signature beyond those that number the suffixes: one in 2 ** SPARE of the leaves is sent on in vain.
SPARE = 8
RUN = 3
_BINS = 1 << 15
_NO_ID = np.iinfo(np.int64).max


# Numbers and words as bytes.


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, so that what is small compresses away."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, n).T).view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return struct.pack("<I", len(values)) + zstandard.compress(_planes(np.diff(values, prepend=np.uint64(0))), 1)


def _unpack_sorted(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    with np.errstate(over="ignore"):
        return np.cumsum(_unplanes(zstandard.decompress(data[4:]), n), dtype=np.uint64)


class Suffixes:
    """Suffixes by their words: a row of numbers each, in a list of the words (ascending bytes), and a document for each."""

    def __init__(self, words: pa.Array, rows: np.ndarray, docs: np.ndarray):
        self.words, self.rows, self.docs = words, rows, docs

    def pack(self, follows: np.ndarray | None = None) -> bytes:
        """follows: which suffixes start a word after the one before them, in the same document. Stretches of such have their words once;
        numbers of the words that occur go by planes of bytes, documents from the smallest."""
        n, depth = self.rows.shape
        first = np.ones(n, dtype=bool) if follows is None else ~follows
        starts = np.flatnonzero(first)
        many = np.diff(np.r_[starts, n])
        text = np.empty(n + len(starts) * (depth - 1), dtype=np.int64)
        at = np.arange(n) + (np.cumsum(first) - 1) * (depth - 1)  # where in text each suffix starts
        text[at] = self.rows[:, 0]
        ends = at[starts + many - 1]
        text[ends[:, None] + np.arange(1, depth)] = self.rows[starts + many - 1, 1:]
        occurs = np.zeros(len(self.words), dtype=bool)
        occurs[text] = True
        words = self.words.take(pa.array(np.flatnonzero(occurs)))
        kind = "<u2" if len(words) <= 1 << 16 else "<u4"
        numbers = (np.cumsum(occurs) - 1).astype(kind)[text].view(np.uint8).reshape(len(text), -1).T
        docs = self.docs[starts]
        low = int(docs.min())
        away = (docs.view(np.uint64) - np.uint64(low % 2**64)).astype(np.uint64)
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        sizes = np.diff(offsets).astype("<u4")
        body = sizes.tobytes() + words.buffers()[2].slice(int(offsets[0]), int(sizes.sum())).to_pybytes() + many.astype("<u4").tobytes() + np.ascontiguousarray(numbers).tobytes() + _planes(away)
        return struct.pack("<IIIIIq", len(starts), len(text), depth, len(words), int(sizes.sum()), low) + zstandard.compress(body, 1)

    @classmethod
    def unpack(cls, data: bytes) -> Suffixes:
        n, n_text, depth, n_words, size, low = struct.unpack_from("<IIIIIq", data)
        raw = zstandard.decompress(data[28:])
        offsets = np.r_[0, np.cumsum(np.frombuffer(raw, dtype="<u4", count=n_words))].astype(np.int32)
        at = 4 * n_words
        words = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at : at + size])])
        at += size
        many = np.frombuffer(raw, dtype="<u4", count=n, offset=at).astype(np.int64)
        at += 4 * n
        kind = "<u2" if n_words <= 1 << 16 else "<u4"
        numbers = np.frombuffer(raw, dtype=np.uint8, count=n_text * int(kind[-1]), offset=at).reshape(-1, n_text)
        text = np.ascontiguousarray(numbers.T).view(kind).ravel().astype(np.int64)
        docs = (_unplanes(raw[at + n_text * int(kind[-1]) :], n) + np.uint64(low % 2**64)).view(np.int64)
        starts = ragged(many, np.cumsum(many + depth - 1) - (many + depth - 1))
        return cls(words, text[starts[:, None] + np.arange(depth)], np.repeat(docs, many))

    @classmethod
    def union(cls, parts: list[Suffixes]) -> Suffixes:
        """All suffixes of the parts, one part after the other, by one list of words."""
        every = pa.concat_arrays([p.words for p in parts])
        coded = every.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        number = number[coded.indices.to_numpy()] if len(every) else number
        starts = np.cumsum([0, *(len(p.words) for p in parts)])
        rows = np.concatenate([number[p.rows + s] for p, s in zip(parts, starts)])
        return cls(coded.dictionary.take(pa.array(order)), rows, np.concatenate([p.docs for p in parts]))

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes, word by word, and where in it each node at full depth starts."""
        bits = max(1, math.ceil(math.log2(max(2, len(self.words)))))
        per = max(1, 64 // bits)
        keys = []
        for k in range(0, self.rows.shape[1], per):
            key = np.zeros(len(self.rows), dtype=np.uint64)
            for j in range(k, min(k + per, self.rows.shape[1])):
                key = key << np.uint64(bits) | self.rows[:, j].astype(np.uint64)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(max(0, len(order) - 1), dtype=bool)
        for key in keys:
            new |= key[order][1:] != key[order][:-1]
        return order, np.flatnonzero(np.r_[True, new]) if len(order) else order


# Chunks of rows.


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


class _Chunk:
    """The suffixes of a chunk that have DEPTH words."""

    def __init__(self, table: pa.Table, depth: int):
        self.table, self.depth = table, depth
        ids = table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")  # so that of equal suffixes the smallest document comes first
        texts = [t or b"" for t in table.column("text").to_pylist()]
        self.texts = [texts[i] for i in self.order]
        self.words: Words = words_of(self.texts)
        self.hashes = self.words.hashes()
        labels, at = windows(self.hashes, self.words.counts, depth)
        self.text = np.repeat(np.arange(len(ids)), self.words.counts)  # of each word
        self.doc = ids[self.order][self.text]
        by_label = np.argsort(labels, kind="stable")
        label, self.at = labels[by_label], at[by_label]  # where the suffixes start, by label and then by document
        self.first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, np.int64)
        self.many = np.diff(np.r_[self.first, len(label)])
        self.labels = label[self.first]

    def signatures(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ones, in order, and for each distinct label its signature's number."""
        own = self.labels >> np.uint64(64 - bits)
        new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, dtype=bool)
        return own[new], np.cumsum(new) - 1

    def bins(self, at: np.ndarray) -> np.ndarray:
        """The counting bin of the suffixes that start at some words: by the least hash of the runs in their first words."""
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        run = min(RUN, self.depth)
        n = len(self.hashes) - run + 1
        h = self.hashes[:n].copy()
        with np.errstate(over="ignore"):
            for k in range(1, run):
                h = mix(h * np.uint64(3) + self.hashes[k : n + k])
        least = h[: n - (self.depth - run)].copy()
        for k in range(1, self.depth - run + 1):
            np.minimum(least, h[k : len(least) + k], out=least)
        with np.errstate(over="ignore"):
            return (mix(least[at] + np.uint64(1)) % np.uint64(_BINS)).astype(np.int64)

    def deep(self, bits: int, elsewhere: np.ndarray) -> np.ndarray:
        """Which distinct labels may be a node at full depth: those whose signature (of the distinct ones, in order) another chunk has, or that several documents have here."""
        if not len(self.first):
            return np.zeros(0, dtype=bool)
        _, number = self.signatures(bits)
        last = self.first + self.many - 1
        return elsewhere[number] | (self.doc[self.at[self.first]] != self.doc[self.at[last]])

    def ask(self, deep: np.ndarray, base: np.ndarray, ways: np.ndarray) -> None:
        """Sets places (all suffixes under the deep labels), own (for each of them its representative), representatives, and groups."""
        data = self.words.buffer[ragged(self.words.end - self.words.start, self.words.start)]
        offsets = np.r_[0, np.cumsum(self.words.end - self.words.start)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        self.dictionary, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        places = self.at[ragged(self.many[deep], self.first[deep])]
        head = np.repeat(self.at[self.first[deep]], self.many[deep])
        rest = np.flatnonzero(places != head)
        for j in range(self.depth):
            differ = number[places[rest] + j] != number[head[rest] + j]
            head[rest[differ]] = places[rest[differ]]
        # Equal labels nearly always are equal words; suffixes that differ from the first of their label stand for themselves.
        stands = np.zeros(len(self.hashes), dtype=bool)
        stands[head] = True
        found, own = np.flatnonzero(stands), (np.cumsum(stands) - 1)[head]
        bins = self.bins(found)
        group = base[bins]
        split = np.flatnonzero(ways[bins] > 1)
        if len(split):
            # The last resort parts a bin by a hash of all words.
            part = np.zeros(len(split), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(self.depth):
                    part = mix(part * np.uint64(5) + self.hashes[found[split] + j])
            group[split] += (part % ways[bins[split]].astype(np.uint64)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.places, self.own, self.representatives, self.groups, self.number = places, back[own], found[order], group[order], number

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """group, start and end of the representatives of each group."""
        starts = np.flatnonzero(np.r_[True, np.diff(self.groups) != 0]) if len(self.groups) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(self.groups)]):
            yield int(self.groups[a]), a, b

    def suffixes(self, a: int, b: int) -> Suffixes:
        at = self.representatives[a:b]
        return Suffixes(self.dictionary, self.number[at[:, None] + np.arange(self.depth)], self.doc[at])

    def packed(self, a: int, b: int) -> bytes:
        at = self.representatives[a:b]
        return self.suffixes(a, b).pack(np.r_[False, (np.diff(at) == 1) & (self.text[at[1:]] == self.text[at[:-1]])])


def _pack(docs: DataFrame) -> DataFrame:
    """chunk, data (whole rows) and size (bytes of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            row = {"chunk": [(part << 32) + number], "data": [sink.getvalue().to_pybytes()], "size": [size]}
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pydict(row, pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("size", pa.int64())]))

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False) + 1) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES - size, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(sizes[stop - 1] - before)
                at = stop
                if size >= CHUNK_BYTES - 1024 or at < batch.num_rows:
                    yield close()
        if held:
            yield close()
        release()

    return materialize(docs.mapInArrow(run, "chunk long, data binary, size long"), "chunks")


# Groups: what is sent, what comes back.

_SENT = "chunk long, set long, group long, payload binary"
_BITS = "chunk long, group long, bits binary"
_PARTS = 16  # sums of counts that go to the driver
#: Of payloads: how many entries each has, a node for each entry, a bit for each entry, and the nodes as one payload.
_Read = Callable[[list[bytes]], tuple[list[int], np.ndarray, np.ndarray, Callable[[], bytes]]]


def _signatures(payloads: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, Callable[[], bytes]]:
    """An entry's bit: another payload has that signature."""
    parts = [_unpack_sorted(p) for p in payloads]
    values, node, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return [len(p) for p in parts], node, many[node] > 1, lambda: _pack_sorted(values)


def _subtree(payloads: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, Callable[[], bytes]]:
    """One group's subtree. An entry's bit: its node has a smaller document."""
    parts = [Suffixes.unpack(p) for p in payloads]
    every = Suffixes.union(parts)
    order, starts = every.tree()
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    low = np.minimum.reduceat(every.docs[order], starts)
    return [len(p.docs) for p in parts], node, low[node] < every.docs, lambda: Suffixes(every.words, every.rows[order[starts]], low).pack()


def _told(pdf: pd.DataFrame, sizes: list[int], bits: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"chunk": pdf["chunk"], "group": pdf["group"], "bits": [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]})


def _asked(sent: DataFrame, sets: int, read: _Read, name: str) -> DataFrame:
    """What the groups say to each chunk. With several sets, each is merged before its group is, and hears the group's answer for its nodes."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["group"].iloc[0] < 0:  # counts
            total = sum(np.frombuffer(zstandard.decompress(p), dtype="<u8") for p in pdf["payload"])
            return pd.DataFrame({"chunk": [-1], "group": pdf["group"].iloc[:1], "bits": [zstandard.compress(total.tobytes())]})
        sizes, _, bits, _ = read(pdf["payload"].tolist())
        return _told(pdf, sizes, bits)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["set"].iloc[:1], "group": pdf["group"].iloc[:1], "payload": [read(pdf["payload"].tolist())[3]()]})

    def hear(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        sizes, node, bits, _ = read(pdf["payload"].tolist())
        said = np.unpackbits(np.frombuffer(above["bits"].iloc[0], dtype=np.uint8))[: int(node.max()) + 1].astype(bool)
        return _told(pdf, sizes, bits | said[node])

    if sets == 1:
        return materialize(sent.groupBy("group").applyInPandas(lambda pdf: then_trim(answer, pdf), _BITS), name)
    sent = materialize(sent, f"{name}-sent")
    merged = sent.where("group >= 0").groupBy("group", "set").applyInPandas(lambda pdf: then_trim(merge, pdf), "chunk long, group long, payload binary")
    above = merged.groupBy("group").applyInPandas(lambda pdf: then_trim(answer, pdf), _BITS)
    heard = sent.where("group >= 0").groupBy("group", "set").cogroup(above.groupBy("group", "chunk")).applyInPandas(lambda pdf, above: then_trim(hear, pdf, above), _BITS)
    out = materialize(heard.unionByName(sent.where("group < 0").groupBy("group").applyInPandas(lambda pdf: then_trim(answer, pdf), _BITS)), name)
    drop(sent)
    return out


def _plan(counts: np.ndarray, group_suffixes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its first group, and over how many it goes."""
    size = len(counts)
    limit = max(1, min(group_suffixes, int(counts.sum()) // FEWEST_GROUPS))
    base, ways = np.zeros(size, dtype=np.int64), np.ones(size, dtype=np.int64)
    group, filled = 0, 0
    for k, n in enumerate(counts.tolist()):
        if n > limit:
            group += filled > 0
            base[k], ways[k] = group, -(-n // limit)
            group, filled = group + int(ways[k]), 0
        else:
            if filled + n > limit:
                group, filled = group + 1, 0
            base[k] = group
            filled += n
    return base, ways


def remove_repeats(docs: DataFrame, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES, fan_in: int = FAN_IN, spans: bool = False) -> DataFrame:
    """docs with repeated passages cut out of text, and n_words and n_removed, for each row.

    A word goes if a window of depth words over it also starts in a document with a smaller doc_id; windows are judged on the whole
    input. With a word goes the white space after it; other white space stays. Words are bytes, whether these are UTF-8 or not. Rows with
    equal doc_ids do not touch each other, and a null doc_id counts as the largest. Null texts stay null and have no words. All rows and
    other columns stay as they are, but for columns named n_words, n_removed and, with spans, spans, in any case, which are replaced. spans: also
    the passages that went, each as its first word (from 0) and its number of words. An empty table has no rows. A row larger than a
    chunk is a chunk of its own. Each chunk sends a row to each group: for inputs of many terabytes take larger chunks and groups.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_removed", *(["spans"] if spans else [])]
    own, _ = apart(docs, ("doc_id", "text"))
    at = [i for i, c in enumerate(docs.columns) if c.lower() not in new]
    kept = own.select([own.columns[i] for i in at]).withColumn("text", F.col("text").cast("binary"))
    chunks = _pack(kept)
    n_chunks, size = chunks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sets = max(1, -(-n_chunks // fan_in))
    bits = min(64, math.ceil(math.log2(max(2, size / 4))) + SPARE)
    ranges = max(1, -(-size // (6 * group_suffixes)), min(FEWEST_GROUPS, n_chunks))
    edges = np.array([-(-(r << bits) // ranges) for r in range(1, ranges)], dtype=np.uint64)

    def send_signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"]):
                c = _Chunk(_table(data), depth)
                if not len(c.first):
                    continue
                counts = np.bincount(c.bins(c.at), minlength=_BINS).astype("<u8")
                own, _ = c.signatures(bits)
                cuts = np.r_[0, np.searchsorted(own, edges), len(own)]
                some = np.flatnonzero(np.diff(cuts))
                payloads = [_pack_sorted(own[cuts[g] : cuts[g + 1]]) for g in some]
                yield pd.DataFrame({"chunk": chunk, "set": _set(chunk, sets), "group": [*some.tolist(), -1 - chunk % _PARTS], "payload": [*payloads, zstandard.compress(counts.tobytes(), 1)]})
        release()

    elsewhere = _asked(chunks.select("chunk", "data").mapInPandas(send_signatures, _SENT), sets, _signatures, "signatures")
    # One number for each bin, of which there is a fixed number.
    found = [np.frombuffer(zstandard.decompress(r["bits"]), dtype="<u8") for r in elsewhere.where("group < 0").select("bits").collect()]
    counts = np.sum(found, axis=0, dtype=np.int64) if found else np.zeros(_BINS, dtype=np.int64)
    plan = docs.sparkSession.sparkContext.broadcast(_plan(counts, group_suffixes))

    def reread(data: bytes, said: dict[int, bytes]) -> _Chunk:
        trim()  # of the chunk before
        forget()
        c = _Chunk(_table(data), depth)
        own, _ = c.signatures(bits)
        cuts = np.r_[0, np.searchsorted(own, edges), len(own)]
        there = [np.unpackbits(np.frombuffer(said[int(g)], dtype=np.uint8), count=int(cuts[g + 1] - cuts[g])) for g in np.flatnonzero(np.diff(cuts))]
        c.ask(c.deep(bits, np.concatenate(there).astype(bool) if there else np.zeros(0, bool)), *plan.value)
        return c

    def send_suffixes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, data in zip(left["chunk"], left["data"]):
            c = reread(data, dict(zip(right["group"], right["bits"])))
            rows += [(chunk, _set(chunk, sets), group, c.packed(a, b)) for group, a, b in c.runs()]
        return pd.DataFrame(rows, columns=["chunk", "set", "group", "payload"])

    said = elsewhere.where("group >= 0")
    sent = chunks.select("chunk", "data").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(lambda left, right: then_trim(send_suffixes, left, right), _SENT)
    repeats = _asked(sent, sets, _subtree, "repeats")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        answers: tuple[dict, dict] = ({}, {})
        for tree, group, own in zip(right.column("tree").to_pylist(), right.column("group").to_pylist(), right.column("bits").to_pylist()):
            answers[tree][group] = own
        return pa.concat_tables([_cut(reread(data, answers[0]), answers[1], spans) for data in left.column("data").to_pylist()])

    both = said.withColumn("tree", F.lit(0)).unionByName(repeats.withColumn("tree", F.lit(1)))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])))
    out = chunks.select("chunk", "data").groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lambda left, right: then_trim(cut, left, right), schema)
    out = out.withColumn("text", F.col("text").cast("string")) if own.schema["text"].dataType == T.StringType() else out
    return out.toDF(*[docs.columns[i] for i in at], *new)


def _set(chunk: int, sets: int) -> int:
    return int(mix(np.array([chunk], dtype=np.uint64))[0] % np.uint64(sets))


def _cut(c: _Chunk, said: dict[int, bytes], spans: bool) -> pa.Table:
    table, w = c.table, c.words
    smaller = [np.unpackbits(np.frombuffer(said[group], dtype=np.uint8), count=b - a) for group, a, b in c.runs()]
    gone = np.zeros(len(c.hashes), dtype=bool)
    if smaller:
        repeat = np.concatenate(smaller).astype(bool)[c.own] | (c.doc[c.places] > c.doc[c.representatives[c.own]])
        # The words under a repeated window: one more at its start, one less after its end.
        at = c.places[repeat]
        edge = np.bincount(at, minlength=len(gone) + 1) - np.bincount(at + c.depth, minlength=len(gone) + 1)
        gone = np.cumsum(edge[:-1]) > 0
    sums = np.r_[0, np.cumsum(gone)]
    removed = sums[w.first[1:]] - sums[w.first[:-1]]
    # Bytes of removed words, up to the next word or the end of the text.
    text_start = np.cumsum([0, *(len(t) + 1 for t in c.texts)])
    out: list[bytes | None] = []
    passages: list[list[dict]] = []
    nulls = table.column("text").is_null().to_numpy()[c.order] if len(c.texts) else []
    for k, text in enumerate(c.texts):
        passages.append([])
        if nulls[k]:
            out.append(None)
        elif not removed[k]:
            out.append(text)
        else:
            a, b = w.first[k], w.first[k + 1]
            start = w.start[a:b] - text_start[k]
            stay = ~gone[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, stay, False].astype(np.int8)))
            stops = np.r_[start, len(text)]
            pieces = [text[: start[0]]] if stay[0] and start[0] else []
            pieces += [text[start[x] : stops[y]] for x, y in zip(edges[0::2], edges[1::2])]
            out.append(b"".join(pieces))
            if spans:
                ends = np.flatnonzero(np.diff(np.r_[False, ~stay, False].astype(np.int8)))
                passages[-1] = [{"first": int(x), "words": int(y - x)} for x, y in zip(ends[0::2], ends[1::2])]
    back = np.argsort(c.order, kind="stable")
    at = table.schema.get_field_index("text")
    result = table.set_column(at, table.schema.field(at), pa.array([out[i] for i in back], type=table.schema.field(at).type))
    result = result.append_column("n_words", pa.array(w.counts[back], pa.int64())).append_column("n_removed", pa.array(removed[back].astype(np.int64), pa.int64()))
    if spans:
        result = result.append_column("spans", pa.array([passages[i] for i in back], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))))
    return result
