"""Exact dedup of byte strings by suffix arrays, in shards.

A window is DEPTH bytes of one text. Its anchor is the gram of least hash among its first bytes, so equal windows have equal anchors at equal
places, and neighbouring windows mostly share theirs. Only what surrounds an anchor that occurs again, by a signature of the bytes after
it that every such window holds, is looked at further: its windows, as one stretch of text, go to the shard of the anchor's gram. There the distinct
stretches are one text, whose suffix array is made by induced sorting (see suffix_array), and a window is repeated if its suffix shares
DEPTH bytes with another window's, or if its stretch itself came more than once.

Rows are packed into chunks once. A chunk sends each shard its distinct stretches and gets a bit a window back. A shard that a common anchor makes too
large gives up its stretches: their windows are dealt anew by a digest of all their bytes, a chunk's distinct ones, so what a third
of all texts have costs a digest a chunk. Signatures and anchors only spare work; windows count as equal by their bytes, or in such a shard by their
BLAKE2b digests of 128 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import drop, materialize, small_batches, without
from gleaner.llm.held import forget, release, then_trim, trim
from gleaner.llm.suffix_array import common_prefixes, suffix_array
from gleaner.llm.suffixes import _asked, _pack, _pack_sorted, _set, _signatures, _table
from gleaner.llm.words import mix, ragged

DEPTH = 400
GRAM = 16
#: Bytes of stretches in a shard, which bound what a task holds; a shard with more, or with so many times its share of all, is dealt anew.
SHARD_BYTES = 4 << 20
LARGE = 4
FEWEST_SHARDS = 96
FAN_IN = 4096
#: Bits of a signature beyond those that number the anchors.
SPARE = 8
#: Bytes of a text that are hashed at once.
_STEP = 2 << 20
_STATE = -1
_SENT = "chunk long, set long, group long, payload binary"
_BITS = "chunk long, group long, bits binary"


class Shape:
    """How a depth is shared out: an anchor lies within the first `width` bytes of a window, and `after` bytes from it are in the window."""

    def __init__(self, depth: int):
        self.depth = depth
        self.width = max(1, depth * 5 // 8)
        self.after = depth - self.width + 1
        self.gram = min(GRAM, self.after)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, 0x9E3779B97F4A7C15, dtype=np.uint64)], dtype=np.uint64)


def _hashes(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the bytes at some places."""
    powers, out = _powers(size), np.empty(len(at), dtype=np.uint64)
    if not len(at):
        return out
    views = np.lib.stride_tricks.sliding_window_view(buffer, size)
    with np.errstate(over="ignore"):
        for k in range(0, len(at), 8192):
            out[k : k + 8192] = ((views[at[k : k + 8192]].astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1)
        return mix(out)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return keys


def _anchors(buffer: np.ndarray, shape: Shape) -> np.ndarray:
    """The anchor of the window at each place of the buffer that has one."""
    n = len(buffer) - shape.gram + 1
    h = (buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    have = 1
    with np.errstate(over="ignore"):
        factor = np.uint64(0x9E3779B97F4A7C15)
        while have < shape.gram:
            step = min(have, shape.gram - have)
            # Two overlapping parts tell a gram as well as two that meet.
            h = h[: len(h) - step] * factor + h[step:]
            h ^= h >> np.uint64(29)
            have += step
            factor = factor * factor + np.uint64(2)
        h = h[:n] * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(max(1, len(buffer)).bit_length())
    keys = (h >> bits << bits) | np.arange(n, dtype=np.uint64)  # of equal grams the first
    return (_least(keys, shape.width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[: max(0, len(buffer) - shape.depth + 1)]


def _runs(buffer: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, number and anchor of each run of windows that share an anchor, over all texts; ends: where each text ends."""
    starts, counts, anchors = [], [], []
    for at in range(0, len(buffer), _STEP):
        part = buffer[at : at + _STEP + shape.depth - 1]
        if len(part) < shape.depth:
            break
        anchor = _anchors(part, shape)
        place = np.arange(len(anchor)) + at
        text = np.repeat(np.arange(len(ends)), np.diff(np.clip(ends, at, at + len(anchor)), prepend=at))
        inside = place + shape.depth <= ends[text]
        place, anchor, text = place[inside], anchor[inside] + at, text[inside]
        if not len(place):
            continue
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        starts.append(place[new])
        counts.append(np.diff(np.r_[new, len(place)]))
        anchors.append(anchor[new])
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else none for x in (starts, counts, anchors))


def _arrays(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<Q", len(a)) for a in arrays) + zstandard.compress(b"".join(np.ascontiguousarray(a.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays), 1)


def _unarrays(data: bytes, k: int) -> list[np.ndarray]:
    sizes, raw, out, at = struct.unpack_from(f"<{k}Q", data), zstandard.decompress(data[8 * k :]), [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return out


class _Chunk:
    def __init__(self, data: bytes):
        self.table = _table(data)
        self.texts = [t or b"" for t in self.table.column("text").to_pylist()]
        self.buffer = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64) if self.texts else np.zeros(0, np.int64)


# Stretches of text.


def _pack_stretches(stretches: list[bytes], twice: np.ndarray) -> bytes:
    sizes = np.array([len(s) for s in stretches], dtype="<u4")
    return struct.pack("<I", len(sizes)) + zstandard.compress(sizes.tobytes() + np.packbits(twice).tobytes() + b"".join(stretches), 1)


def _unpack_stretches(data: bytes) -> tuple[list[bytes], np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    raw = zstandard.decompress(data[4:])
    sizes = np.frombuffer(raw, dtype="<u4", count=n).astype(np.int64)
    flags = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=(n + 7) // 8, offset=4 * n), count=n).astype(bool)
    at = 4 * n + (n + 7) // 8 + np.r_[0, np.cumsum(sizes)]
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], flags


def _shard(depth: int):
    """Reads a shard's payloads, for suffixes._asked: an entry is a window, its bit whether it is repeated."""

    def read(payloads: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, object]:
        number: dict[bytes, int] = {}
        many: list[int] = []
        owns = []
        for payload in payloads:
            stretches, twice = _unpack_stretches(payload)
            own = []
            for s, t in zip(stretches, twice.tolist()):
                k = number.setdefault(s, len(many))
                if k == len(many):
                    many.append(0)
                many[k] += 1 + t
                own.append(k)
            owns.append(np.array(own, dtype=np.int64))
        distinct = list(number)
        windows = np.array([len(s) - depth + 1 for s in distinct], dtype=np.int64)
        first = np.r_[0, np.cumsum(windows)]
        again = np.array(many) > 1
        bits = np.repeat(again, windows)
        text = np.frombuffer(b"".join(distinct), dtype=np.uint8)
        size = windows + depth - 1
        # Suffixes are compared beyond their stretches: one that runs over an end may read as a window does and lie between two equal ones.
        room = np.minimum(len(text) - np.arange(len(text)), depth)
        window = np.zeros(len(text), dtype=bool)
        window[ragged(windows, np.cumsum(size) - size)] = True
        order = suffix_array(text, depth)
        order = order[window[order]]  # equal windows stay neighbours when the other suffixes are left out
        same = common_prefixes(text, order, room)[order] >= depth
        found = np.zeros(len(text), dtype=bool)
        found[order] = same | np.r_[same[1:], False]
        bits |= found[window]
        node = [ragged(windows[own], first[own]) for own in owns]
        return [len(x) for x in node], np.concatenate(node), bits[np.concatenate(node)], lambda: _pack_stretches(distinct, again)

    return read


# Shards that are too large.


def _digests(payload: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests of a payload's windows, which of them came more than once, and the number of each window's."""
    stretches, twice = _unpack_stretches(payload)
    found = b"".join(hashlib.blake2b(memoryview(s)[k : k + depth], digest_size=16).digest() for s in stretches for k in range(len(s) - depth + 1))
    windows = np.array([len(s) - depth + 1 for s in stretches], dtype=np.int64)
    kinds, number, many = np.unique(np.frombuffer(found, dtype="<u8").reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
    number = number.ravel()
    more = many > 1
    more[number[np.repeat(twice, windows)]] = True
    return kinds, more, number


def _large(rows: DataFrame, depth: int) -> DataFrame:
    """The bits of the windows of rows (chunk, set, group, payload, ways), by their digests."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, group, ways, payload in zip(pdf["chunk"], pdf["group"], pdf["ways"], pdf["payload"]):
                kinds, more, _ = _digests(payload, depth)
                part = (kinds[:, 0] % np.uint64(ways)).astype(np.int64)
                for p in np.unique(part):
                    at = part == p
                    yield pd.DataFrame({"chunk": [chunk], "group": group, "part": p, "payload": [struct.pack("<I", int(at.sum())) + np.packbits(more[at]).tobytes() + kinds[at].tobytes()]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds, more = [], []
        for data in pdf["payload"]:
            (n,) = struct.unpack_from("<I", data)
            more.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=(n + 7) // 8, offset=4), count=n).astype(bool))
            kinds.append(np.frombuffer(data, dtype="<u8", offset=4 + (n + 7) // 8).reshape(-1, 2))
        sizes = [len(k) for k in kinds]
        _, number, many = np.unique(np.concatenate(kinds), axis=0, return_inverse=True, return_counts=True)
        bits = (many[number.ravel()] > 1) | np.concatenate(more)
        return pd.DataFrame({"chunk": pdf["chunk"], "group": pdf["group"], "part": pdf["part"], "bits": [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]})

    def hear(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        said, out = dict(zip(right["part"], right["bits"])), []
        for chunk, group, ways, payload in zip(left["chunk"], left["group"], left["ways"], left["payload"]):
            kinds, _, number = _digests(payload, depth)
            part = (kinds[:, 0] % np.uint64(ways)).astype(np.int64)
            bits = np.zeros(len(kinds), dtype=bool)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                bits[at] = np.unpackbits(np.frombuffer(said[p], dtype=np.uint8), count=len(at)).astype(bool)
            out.append((chunk, group, np.packbits(bits[number]).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "group", "bits"])

    told = rows.mapInPandas(send, "chunk long, group long, part long, payload binary").groupBy("group", "part").applyInPandas(answer, "chunk long, group long, part long, bits binary")
    told = materialize(told, "large-shards")
    return rows.groupBy("chunk", "group").cogroup(told.groupBy("chunk", "group")).applyInPandas(hear, _BITS)


# The whole.


def remove_byte_repeats(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, fewest_shards: int = FEWEST_SHARDS, fan_in: int = FAN_IN, spans: bool = False) -> DataFrame:
    """docs without what repeats: text, as binary, is what is left of its UTF-8 bytes, with n_bytes, n_removed and n_spans (removed runs).

    A byte goes if some `depth` bytes of its text that hold it also start anywhere else, in this text or another; strings are judged on the
    input, all copies go, and matches stay within texts. A cut may part a character, so text is binary. spans: also the removed runs, each as
    its first byte (from 0) and its number of bytes. A null text stays null and has no bytes; empty texts and those shorter than `depth` stay
    as they are; rows that repeat take each other's bytes; doc_ids play no part. Texts of any length are taken whole; one larger
    than a chunk is a chunk of its own. An empty table has no rows. Columns named n_bytes, n_removed, n_spans and, with spans, spans, in
    any case, are replaced; all others stay.
    """
    small_batches(docs.sparkSession)
    shape = Shape(depth)
    new = ["n_bytes", "n_removed", "n_spans", *(["spans"] if spans else [])]
    own = without(docs, *new)
    plain = own.toDF(*[c if c == "text" else f"__gleaner_at_{i}" for i, c in enumerate(own.columns)])
    kept = plain.withColumn("text", F.col("text").cast("binary"))
    chunks = _pack(kept)
    n_chunks, size = chunks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sets = max(1, -(-n_chunks // fan_in))
    bits = min(64, max(1, int(2 * size / shape.width)).bit_length() + SPARE)
    ranges = max(1, -(-size // (64 << 20)), min(FEWEST_SHARDS, n_chunks))
    edges = np.array([-(-(r << bits) // ranges) for r in range(1, ranges)], dtype=np.uint64)
    shards = max(fewest_shards, -(-size // shard_bytes))

    def send_signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"]):
                c = _Chunk(data)
                start, many, anchor = _runs(c.buffer, c.ends, shape)
                places, of_run = np.unique(anchor, return_inverse=True)
                value = _hashes(c.buffer, places, shape.after) >> np.uint64(64 - bits)
                signature, number, times = np.unique(value, return_inverse=True, return_counts=True)
                twice = np.packbits(times > 1).astype(np.int64)
                state = _arrays(np.diff(start, prepend=0), many, anchor - start, number[of_run] if len(start) else start, twice, np.array([len(signature)]), np.searchsorted(signature, edges))
                cuts = np.r_[0, np.searchsorted(signature, edges), len(signature)]
                some = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"chunk": chunk, "set": _set(chunk, sets), "group": [_STATE, *some.tolist()], "payload": [state, *[_pack_sorted(signature[cuts[g] : cuts[g + 1]]) for g in some]]})
                trim()
        release()

    sent = materialize(chunks.select("chunk", "data").mapInPandas(send_signatures, _SENT), "anchors")
    elsewhere = _asked(sent.where("group >= 0"), sets, _signatures, "anchors-said")
    said = sent.where(F.col("group") == _STATE).select("chunk", "group", F.col("payload").alias("bits")).unionByName(elsewhere.select("chunk", "group", "bits"))

    def send_stretches(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        told = dict(zip(right["group"], right["bits"]))
        for chunk, data in zip(left["chunk"], left["data"]):
            trim()
            c = _Chunk(data)
            step, many, off, number, twice, n, inner = _unarrays(told[_STATE], 7)
            cuts = np.r_[0, inner, n]
            parts = [np.unpackbits(np.frombuffer(told[int(g)], dtype=np.uint8), count=int(cuts[g + 1] - cuts[g])) for g in np.flatnonzero(np.diff(cuts))]
            again = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
            again |= np.unpackbits(twice.astype(np.uint8), count=len(again)).astype(bool)
            keep = again[number] if len(number) else np.zeros(0, bool)
            start = np.cumsum(step)[keep]
            many = many[keep]
            gram = _hashes(c.buffer, start + off[keep], shape.gram)
            raw = c.buffer.tobytes()
            kinds: dict[bytes, int] = {}
            of_run = np.array([kinds.setdefault(raw[a : a + m + depth - 1], len(kinds)) for a, m in zip(start.tolist(), many.tolist())], dtype=np.int64)
            distinct = list(kinds)
            group = np.zeros(len(distinct), dtype=np.int64)
            group[of_run] = (mix(gram + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
            times = np.bincount(of_run, minlength=len(distinct))
            order = np.argsort(group, kind="stable")
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            ranges_ = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else order
            for a, b in zip(ranges_.tolist(), [*ranges_[1:].tolist(), len(order)]):
                at = order[a:b]
                rows.append((chunk, _set(chunk, sets), int(group[at[0]]), _pack_stretches([distinct[i] for i in at], times[at] > 1)))
            windows = np.array([len(distinct[i]) - depth + 1 for i in order], dtype=np.int64)
            per_shard = np.add.reduceat(windows, ranges_) if len(ranges_) else windows
            rows.append((chunk, 0, _STATE, _arrays(start, many, back[of_run] if len(of_run) else of_run, per_shard)))
        return pd.DataFrame(rows, columns=["chunk", "set", "group", "payload"])

    stretches = materialize(chunks.select("chunk", "data").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(lambda left, right: then_trim(send_stretches, left, right), _SENT), "stretches")
    drop(sent, elsewhere)
    rows = stretches.where("group >= 0")
    loads = materialize(rows.groupBy("group").agg(F.sum(F.octet_length("payload")).alias("load")), "loads")
    total = loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    limit = max(1, min(shard_bytes, LARGE * total // shards))
    large = loads.where(F.col("load") > limit).select("group", F.ceil(F.col("load") * LARGE / limit).alias("ways"))
    if large.isEmpty():
        repeats = _asked(rows, sets, _shard(depth), "repeats")
    else:
        repeats = _asked(rows.join(large.select("group"), "group", "left_anti").select("chunk", "set", "group", "payload"), sets, _shard(depth), "repeats")
        # Dealt by rows, as one shard has many.
        spread = rows.join(large, "group").repartition(F.xxhash64("chunk", "group"))
        repeats = repeats.unionByName(_large(materialize(spread, "large"), depth))
    final = stretches.where(F.col("group") == _STATE).select("chunk", "group", F.col("payload").alias("bits")).unionByName(repeats.select("chunk", "group", "bits"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        told = dict(zip(right.column("group").to_pylist(), right.column("bits").to_pylist()))
        return pa.concat_tables([_cut(_Chunk(data), told, depth, spans) for data in left.column("data").to_pylist()])

    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T.LongType()) for n in new[:3]]])
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("bytes", T.LongType())])))
    out = chunks.select("chunk", "data").groupBy("chunk").cogroup(final.groupBy("chunk")).applyInArrow(lambda left, right: then_trim(cut, left, right), schema)
    return out.toDF(*own.columns, *new)


def _cut(c: _Chunk, told: dict[int, bytes], depth: int, spans: bool) -> pa.Table:
    start, many, own, per_shard = _unarrays(told[_STATE], 4)
    # Each distinct stretch has so many windows; a shard's bits are those of its stretches, in order.
    windows = np.zeros(int(own.max()) + 1 if len(own) else 0, dtype=np.int64)
    windows[own] = many
    first = np.r_[0, np.cumsum(windows)]
    found = [np.unpackbits(np.frombuffer(told[g], dtype=np.uint8), count=int(n)).astype(bool) for g, n in zip(sorted(g for g in told if g >= 0), per_shard)]
    bits = np.concatenate(found) if found else np.zeros(0, dtype=bool)
    place = ragged(many, start)[bits[ragged(many, first[own])]]
    n = len(c.buffer)
    edge = np.bincount(place, minlength=n + 1) - np.bincount(place + depth, minlength=n + 1) if len(place) else np.zeros(n + 1, np.int64)
    gone = np.cumsum(edge[:n]) > 0
    raw, out, removed, runs, passages, a = c.buffer.tobytes(), [], [], [], [], 0
    for b in c.ends.tolist():
        part = gone[a:b]
        if part.any():
            change = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8)))
            low, high = change[0::2], change[1::2]
            stay = np.r_[0, high], np.r_[low, b - a]
            out.append(b"".join(raw[a + x : a + y] for x, y in zip(*map(np.ndarray.tolist, stay))))
            removed.append(int((high - low).sum()))
            runs.append(len(low))
            passages.append([{"first": int(x), "bytes": int(y - x)} for x, y in zip(low, high)] if spans else None)
        else:
            out.append(raw[a:b])
            removed.append(0)
            runs.append(0)
            passages.append([])
        a = b
    table = c.table
    nulls = table.column("text").is_null().to_pylist()
    at = table.schema.get_field_index("text")
    result = table.set_column(at, table.schema.field(at), pa.array([None if x else t for x, t in zip(nulls, out)], pa.binary()).cast(table.schema.field(at).type))
    for name, values in (("n_bytes", [len(t) for t in c.texts]), ("n_removed", removed), ("n_spans", runs)):
        result = result.append_column(name, pa.array(values, pa.int64()))
    if spans:
        result = result.append_column("spans", pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))))
    return result
