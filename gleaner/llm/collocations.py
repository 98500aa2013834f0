"""Phrases of several words, by hierarchical naming of pairs.

A word of a language that occurs often enough gets a number; an occurrence of a phrase of k words is the pair of the phrases of k - 1 words at
its place and the next, and each such pair that occurs often enough gets a number in turn. A pair holds a rare phrase only if one of its
halves is rare, so rare ones are never paired. The two numbers of a pair point to its parents, the phrase without its last and without
its first word: a phrase's cuts are met by going up one side or the other, and what a longer phrase takes up is told along the same pointers.

Texts are read once and kept as chunks of numbers. In each round a chunk sums its own pairs and deals them by a hash of the pair; whoever gets a
pair has its sums from all chunks, names it if these are enough, and answers each chunk for its own. So a phrase that
everyone uses costs one entry a chunk. Words are compared by their bytes and pairs by their two numbers, never by hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import drop, materialize, pick, small_batches
from gleaner.llm.held import forget, release, trim
from gleaner.llm.words import lowered, mix

LEAST = 30
LONGEST = 4
MOST = 2000
#: A candidate gives way to a longer one with as many hundredths of its occurrences.
SUBSUMED = 80
#: Bytes of text in a chunk, and bytes of text for each group of entries, which bound what a task holds.
CHUNK_BYTES = 8 << 20
GROUP_BYTES = 16 << 20
FEWEST_GROUPS = 96
UNKNOWN = "und"
_SALT = 64

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = 2

_SENT = pa.schema([("chunk", pa.int64()), ("group", pa.int64()), ("payload", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
_NAMED = pa.schema([("chunk", pa.int64()), ("group", pa.int64()), ("payload", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64())])
_STATE, _TOTAL = -1, -2


def _schema(s: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {({pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[f.type]}" for f in s)


# Numbers as bytes.


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers byte by byte, so that what is small compresses away."""
    parts = [np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T for a in arrays]
    return struct.pack("<I", len(arrays)) + b"".join(struct.pack("<Q", p.shape[1]) for p in parts) + zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    raw, at, out = zstandard.decompress(data[4 + 8 * n :]), 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=8 * size, offset=at).reshape(8, size).T).view("<u8").ravel())
        at += 8 * size
    return out


def _packed_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", pa.binary())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([words], names=["w"]))
    return sink.getvalue().to_pybytes()


def _unpacked_words(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().column(0).combine_chunks()


def _joined(a: bytes, b: bytes) -> bytes:
    return struct.pack("<Q", len(a)) + a + b


def _split(data: bytes) -> tuple[bytes, bytes]:
    (n,) = struct.unpack_from("<Q", data)
    return data[8 : 8 + n], data[8 + n :]


# Chunks.


def words_in_pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, lower-cased, the text of each, and a place for each: neighbours in one piece are one apart, others more."""
    buffer = lowered(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))
    kind = _KIND[buffer]
    inside = kind == 0
    change = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = change[0::2], change[1::2]
    piece = np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, np.int64)
    new = np.r_[False, np.diff(piece) != 0] if len(start) else np.zeros(0, bool)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buffer[inside].tobytes())])
    return words, text, np.arange(len(start)) + np.cumsum(new)


def _dealt(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of entries by group, and each group with its range in that order."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, [(int(own[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(own)])]


def _rows(chunk: int, groups: list[int], payloads: list[bytes], totals: dict[str, int] | None = None) -> pa.RecordBatch:
    totals = totals or {}
    n, m = len(groups), len(totals)
    return pa.RecordBatch.from_arrays([
        pa.array([chunk] * (n + m), pa.int64()), pa.array([*groups, *[_TOTAL] * m], pa.int64()), pa.array([*payloads, *[None] * m], pa.binary()),
        pa.array([*[None] * n, *totals], pa.string()), pa.array([*[None] * n, *totals.values()], pa.int64()),
    ], schema=_SENT)


def _word_group(words: pa.Array, lang: np.ndarray, groups: int) -> np.ndarray:
    """The group of each word: a hash of its ends and length will do, as equal words are compared whole where they meet."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    size = np.diff(offsets)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lang.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(16):
            for at in (np.minimum(offsets[:-1] + k, offsets[1:] - 1), np.maximum(offsets[1:] - 1 - k, offsets[:-1])):
                out = out * np.uint64(0x100000001B3) + data[at]
        return (mix(out) % np.uint64(groups)).astype(np.int64)


def _lang_number(lang: str) -> int:
    """A number for a language that every task agrees on."""
    return int.from_bytes(lang.encode()[:7].ljust(7, b"\0"), "little") + len(lang)


def _first_chunk(chunk: int, langs: list[str | None], texts: list[bytes], groups: int) -> pa.RecordBatch:
    words, text, place = words_in_pieces(texts)
    names = sorted({UNKNOWN if x is None else x for x in langs})
    of_text = np.array([names.index(UNKNOWN if x is None else x) for x in langs], dtype=np.int64)
    lang = of_text[text]
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) * len(names) + lang if len(words) else np.zeros(0, np.int64)
    kinds, number, many = np.unique(number, return_inverse=True, return_counts=True)
    word, own = coded.dictionary.take(pa.array(kinds // max(1, len(names)))), kinds % max(1, len(names))
    group = _word_group(word, np.array([_lang_number(n) for n in names], dtype=np.uint64)[own], groups) if len(kinds) else np.zeros(0, np.int64)
    order, runs = _dealt(group)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    out_groups, payloads = [_STATE], [_packed(np.diff(place, prepend=0), back[number])]
    lang_words = pa.array([n.encode() for n in names], pa.binary())
    for g, a, b in runs:
        at = order[a:b]
        out_groups.append(g)
        payloads.append(_joined(_packed_words(word.take(pa.array(at))), _joined(_packed_words(lang_words), _packed(own[at], many[at]))))
    totals = np.bincount(lang, minlength=len(names))
    return _rows(chunk, out_groups, payloads, {n: int(t) for n, t in zip(names, totals)})


def _next_chunk(chunk: int, state: bytes, answers: list[bytes], groups: int, last: bool) -> pa.Table:
    """A chunk's pairs of what was named, dealt out, and its new state. answers: of all its groups, in order."""
    step, number = _unpacked(state)
    ids = np.concatenate([_ids(a) for a in answers]) if answers else np.zeros(0, np.uint64)
    known = np.unique(ids[ids > 0])
    local = np.where(ids > 0, np.searchsorted(known, ids) + 1, 0)[number.astype(np.int64)] if len(ids) else np.zeros(0, np.int64)
    place = np.cumsum(step.astype(np.int64))
    keep = local > 0
    place, local = place[keep], local[keep]
    pair = np.flatnonzero(place[1:] == place[:-1] + 1)
    width = np.uint64(len(known) + 1)
    key = local[pair].astype(np.uint64) * width + local[pair + 1].astype(np.uint64)
    kinds, number, many = np.unique(key, return_inverse=True, return_counts=True)
    left, right = known[(kinds // width).astype(np.int64) - 1], known[(kinds % width).astype(np.int64) - 1]
    with np.errstate(over="ignore"):
        group = (mix(mix(left) + right) % np.uint64(groups)).astype(np.int64)
    order, runs = _dealt(group)
    out_groups, payloads = [], []
    if not last:
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        out_groups, payloads = [_STATE], [_packed(np.diff(place[pair], prepend=0), back[number])]
    for g, a, b in runs:
        at = order[a:b]
        out_groups.append(g)
        payloads.append(_packed(left[at], right[at], many[at]))
    return pa.Table.from_batches([_rows(chunk, out_groups, payloads)])


# Groups.


def _answer(ids: np.ndarray) -> bytes:
    """ids with zeros for what was not named."""
    return _joined(np.packbits(ids > 0).tobytes(), _packed(ids[ids > 0], np.array([len(ids)])))


def _ids(answer: bytes) -> np.ndarray:
    bits, rest = _split(answer)
    some, n = _unpacked(rest)
    out = np.zeros(int(n[0]), dtype=np.uint64)
    out[np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(out)).astype(bool)] = some
    return out


def _named(table: pa.Table, group: int, sizes: list[int], number: np.ndarray, sums: np.ndarray, least: int, groups: int, columns) -> pa.Table:
    """Answers to all chunks, and the names: columns(which) gives lang, word, left and right of the kinds that were named."""
    often = np.flatnonzero(sums >= least)
    ids = np.zeros(len(sums), dtype=np.uint64)
    ids[often] = np.arange(len(often), dtype=np.uint64) * np.uint64(groups) + np.uint64(group + 1)
    parts = np.split(ids[number], np.cumsum(sizes)[:-1])
    n, m = len(sizes), len(often)
    none = lambda k, t: pa.nulls(k, t)
    told = pa.Table.from_arrays([table.column("chunk").combine_chunks(), pa.array([group] * n, pa.int64()), pa.array([_answer(p) for p in parts], pa.binary()), *[none(n, f.type) for f in list(_NAMED)[3:]]], schema=_NAMED)
    names = pa.Table.from_arrays([none(m, pa.int64()), none(m, pa.int64()), none(m, pa.binary()), pa.array(ids[often].astype(np.int64)), pa.array(sums[often].astype(np.int64)), *columns(often)], schema=_NAMED)
    return pa.concat_tables([told, names])


def _sums(number: np.ndarray, kinds: int, many: np.ndarray) -> np.ndarray:
    out = np.zeros(kinds, dtype=np.int64)
    np.add.at(out, number, many.astype(np.int64))
    return out


def _name_words(table: pa.Table, least: int, groups: int) -> pa.Table:
    group = table.column("group")[0].as_py()
    words, langs, owns, manys = [], [], [], []
    for data in table.column("payload").to_pylist():
        w, rest = _split(data)
        l, numbers = _split(rest)
        own, many = _unpacked(numbers)
        words.append(_unpacked_words(w))
        langs.append(_unpacked_words(l).take(pa.array(own.astype(np.int64))))
        owns.append(len(own))
        manys.append(many)
    word, lang = pa.concat_arrays(words).dictionary_encode(), pa.concat_arrays(langs).dictionary_encode()
    key = word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
    kinds, number = np.unique(key, return_inverse=True)
    sums = _sums(number, len(kinds), np.concatenate(manys))

    def columns(which: np.ndarray) -> list[pa.Array]:
        text = lambda a: pa.array([x.decode("utf-8", "replace") for x in a.to_pylist()], pa.string())
        own = kinds[which]
        n = len(which)
        return [text(lang.dictionary.take(pa.array(own % len(lang.dictionary)))), text(word.dictionary.take(pa.array(own // len(lang.dictionary)))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]

    return _named(table, group, owns, number, sums, least, groups, columns)


def _name_pairs(table: pa.Table, least: int, groups: int) -> pa.Table:
    group = table.column("group")[0].as_py()
    parts = [_unpacked(data) for data in table.column("payload").to_pylist()]
    left, right, many = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((right, left))
    l, r = left[order], right[order]
    new = np.r_[True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]
    sums = _sums(number, len(at), many)

    def columns(which: np.ndarray) -> list[pa.Array]:
        n = len(which)
        return [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(left[at[which]].astype(np.int64)), pa.array(right[at[which]].astype(np.int64))]

    return _named(table, group, [len(p[0]) for p in parts], number, sums, least, groups, columns)


def _naming(k: int, least: int, groups: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: (_name_words if k == 1 else _name_pairs)(table, least, groups)


def _applying(last: bool, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_SENT)
        by_group = sorted(zip(right.column("group").to_pylist(), right.column("payload").to_pylist()))
        return _next_chunk(left.column("chunk")[0].as_py(), left.column("payload")[0].as_py(), [p for _, p in by_group], groups, last)

    return apply


def _named_phrases(documents: DataFrame, least: int, longest: int, chunk_bytes: int, group_bytes: int, fewest_groups: int) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to longest words the names (id, f, and lang and word, or left and right), and lang and n, its words."""
    small_batches(documents.sparkSession)
    rows = pick(documents, "lang", "text").select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(fewest_groups, -(-size // group_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        chunk, langs, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and held + len(text) > chunk_bytes:
                    yield _first_chunk(chunk, langs, texts, groups)
                    chunk, langs, texts, held = chunk + 1, [], [], 0
                    trim()
                langs.append(lang)
                texts.append(text)
                held += len(text) + 1
        if texts:
            yield _first_chunk(chunk, langs, texts, groups)
        release()

    sent = materialize(rows.mapInArrow(read, _schema(_SENT)), "words")
    totals = materialize(sent.where(F.col("group") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    names = []
    for k in range(1, longest + 1):
        told = materialize(sent.where("group >= 0").select("chunk", "group", "payload").groupBy("group").applyInArrow(_naming(k, least, groups), _schema(_NAMED)), "names")
        names.append(told.where("id is not null").select("id", "f", *(["lang", "word"] if k == 1 else ["left", "right"])))
        if k == longest:
            drop(sent)
            break

        states = sent.where(F.col("group") == _STATE).select("chunk", "payload")
        answers = told.where("id is null").select("chunk", "group", "payload")
        before = sent
        sent = materialize(states.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_applying(k + 1 == longest, groups), _schema(_SENT)), "pairs")
        drop(before)
    return names, totals


def collocations(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, subsumed: int = SUBSUMED, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES, fewest_groups: int = FEWEST_GROUPS
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score: each language's first `most` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z) and split into pieces at . , ; : ! ? and line ends, these into words at spaces and tabs; phrases stay in a
    piece. a counts a phrase, l and r what its worst cut makes of it, n all words of the language; score is floor(2000000 a / (l + r)). A phrase that
    occurs fewer than `least` times is none, and one that lies in a longer one with `subsumed` hundredths of its occurrences goes. Ties in score go by a,
    then by phrase in the order of bytes, so ranks are unique.

    A null text is empty and a null lang `und`, with those whose lang says so; an empty text, or table, has no words. Rows that repeat count each time,
    and texts of any length are taken whole; a text larger than a chunk is a chunk of its own. Other columns are ignored, whatever their names.
    """
    names, totals = _named_phrases(documents, least, longest, chunk_bytes, group_bytes, fewest_groups)
    grams = [names[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("starts"), F.array("f").alias("ends"))]
    for level in names[1:]:
        side = lambda s: grams[-1].select([F.col(c).alias(f"{s}_{c}") for c in grams[-1].columns])
        pairs = level.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
        grams.append(materialize(pairs.select(
            "id", F.col("l_lang").alias("lang"), F.concat("l_phrase", F.lit(" "), "r_last").alias("phrase"), F.col("r_last").alias("last"),
            F.concat("l_starts", F.array("f")).alias("starts"), F.concat("r_ends", F.array("f")).alias("ends"),
        ), "phrases"))
    exact = lambda c: f"cast({c} as decimal(20, 0))"
    l, r = "starts[j - 1]", "ends[size(starts) - j - 1]"
    cut = f"array_min(transform(sequence(1, size(starts) - 1), j -> struct(cast(2000000 as decimal(7, 0)) * {exact('a')} div ({exact(l)} + {exact(r)}) as score, j as cut, {l} as l, {r} as r)))"
    found = None
    for k, level in enumerate(grams[1:], 2):
        own = level.withColumn("a", F.element_at("starts", -1))
        if k < longest:
            longer = names[k]
            most_of = longer.select(F.col("left").alias("id"), "f").union(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("longer"))
            own = own.join(most_of, "id", "left").where(F.expr(f"longer is null or 100 * {exact('longer')} < {subsumed} * {exact('a')}"))
        own = own.withColumn("worst", F.expr(cut)).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
        found = own if found is None else found.unionByName(own)
    # Parts of a language are ranked first, so that whoever ranks it whole gets a bounded number of rows.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most).drop("part", "rank")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
