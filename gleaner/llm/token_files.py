"""Token-id files as directly addressable codes.

Each id is split into chunks of WIDTHS bits, low chunk first. Level 0 holds the first chunk of every id; level l holds chunk l
of those ids only whose earlier levels go on. A bitmap beside each level but the last says which of its entries go on, and a rank
directory holds the set bits before each block of 512, so that any id is found by one rank a level, with nothing decoded before it.

A shard is one binary value in a table that Spark writes, so that tasks run again after a lost executor and files need no path
that only one machine can open. Layout, little-endian: b"DAC1", uint32 documents, uint32 ids, uint32 levels; document ids int64;
a byte for each document that is 1 where its id is null; first id of each document and the total, uint32; then for each level uint32
entries and the chunks (uint8 or uint16), and, but for the last, the bitmap and its directory (uint32 a block).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.coder import UnitCoder
from gleaner.llm.common import materialize, partitions, pick, text_bytes
from gleaner.llm.held import held, release
from gleaner.llm.words import slices, words_of

#: Bits of each level: together the 32 of any id.
WIDTHS = (8, 8, 16)
BLOCK = 512
SHARD_IDS = 1 << 20
END_ID = 1
#: Ids that a reader asks for together.
AT_ONCE = 1 << 16


def pack(ids: np.ndarray, doc_ids: list[int | None], first: np.ndarray) -> bytes:
    """One shard. first has one more entry than doc_ids."""
    out = [b"DAC1", struct.pack("<III", len(doc_ids), len(ids), len(WIDTHS))]
    out.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes())
    out.append(np.asarray(first, dtype="<u4").tobytes())
    rest = np.asarray(ids, dtype=np.uint32)
    for level, width in enumerate(WIDTHS):
        out += [struct.pack("<I", len(rest)), (rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}").tobytes()]
        if level < len(WIDTHS) - 1:
            high = rest >> np.uint32(width)
            more = high > 0
            bits = np.packbits(more, bitorder="little")
            sums = np.r_[0, np.cumsum(more)][: len(rest) + 1 : BLOCK]
            out += [bits.tobytes(), sums.astype("<u4").tobytes()]
            rest = high[more]
    return b"".join(out)


class Shard:
    """Reads a shard's arrays in place; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        assert data[:4] == b"DAC1", "not a shard"
        self.n_docs, self.n_ids, levels = struct.unpack_from("<III", data, 4)
        self.offset = 16

        def take(kind: str, n: int) -> np.ndarray:
            found = np.frombuffer(data, dtype=kind, count=n, offset=self.offset)
            self.offset += found.nbytes
            return found

        ids, absent = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if a else int(d) for d, a in zip(ids, absent)]
        self.first = take("<u4", self.n_docs + 1).astype(np.int64)
        self.levels: list[tuple] = []
        self.inside: dict[int, np.ndarray] = {}
        for level in range(levels):
            n = int(take("<u4", 1)[0])
            chunks = take(f"<u{WIDTHS[level] // 8}", n)
            last = level == levels - 1
            self.levels.append((chunks, None, None) if last else (chunks, take("u1", -(-n // 8)), take("<u4", n // BLOCK + 1)))

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each by one rank a level: the directory's count, and the set bits of the block before the place."""
        i = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(i), dtype=np.uint32)
        left, shift = np.arange(len(i)), 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out[left] |= chunks[i].astype(np.uint32) << np.uint32(shift)
            shift += WIDTHS[level]
            if bits is None:
                break
            more = bits[i >> 3] >> (i & 7).astype(np.uint8) & 1 > 0
            left, i = left[more], i[more]
            i = directory[i // BLOCK] + self._inside(level)[i >> 3] + np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8))
        return out

    def _inside(self, level: int) -> np.ndarray:
        """For each byte of a bitmap the set bits of its block before it."""
        if level not in self.inside:
            bits = self.levels[level][1]
            blocks = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint16)
            blocks[: len(bits)] = np.bitwise_count(bits)
            blocks = blocks.reshape(-1, BLOCK // 8)
            self.inside[level] = (np.cumsum(blocks, axis=1, dtype=np.uint16) - blocks).ravel().astype(np.int64)
        return self.inside[level]

    def token(self, i: int) -> int:
        """The i-th id: of its levels one chunk each is read, and the bits of its block before it."""
        out = shift = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            shift += WIDTHS[level]
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(directory[block]) + int(before.sum())
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n_ids, dtype=np.uint32)
        at = np.arange(self.n_ids)
        shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            shift += WIDTHS[level]
            if bits is not None:
                at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def _coder(path: str) -> UnitCoder:
    """Words are encoded apart: this vocabulary's tokenizer never joins what white space parts."""

    def make() -> UnitCoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return UnitCoder(lambda units: [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])

    return held(("token files", path), make)


def encode_texts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts, and how many each has."""
    return _coder(path)(words_of(texts))


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Encodes whole texts and writes them as shards in ascending doc_id order (null first, equal ids by their text's hash).

    Returns the written table, read back: part, shard, part_start (ids before the shard in its part), n_tokens, payload. Parts
    follow each other in doc_id order. A null or empty text has the end id alone; an empty table has no shards; texts are encoded whole,
    however long, and rows that repeat are documents of their own; other columns of docs are not read, whatever their names.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        ids, lengths, names = [], [], []

        def close() -> pd.DataFrame:
            nonlocal shard, done
            flat, first = np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(lengths))]
            row = pd.DataFrame({"part": [part], "shard": [shard], "part_start": [done], "n_tokens": [len(flat)], "payload": [pack(flat, names, first)]})
            shard, done = shard + 1, done + len(flat)
            ids.clear(), lengths.clear(), names.clear()
            return row

        for pdf in batches:
            texts, docs_ = pdf["text"].tolist(), [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            for s in slices(texts, 4 << 20):
                flat, n = encode_texts(texts[s], vocabulary)
                ends = np.cumsum(n)
                ids.append(np.insert(flat, ends, end_id))
                lengths.append(n + 1)
                names.extend(docs_[s])
                if sum(map(len, ids)) >= SHARD_IDS:
                    yield close()
        if names:
            yield close()
        release()

    rows = pick(docs, "doc_id", "text").select("doc_id", text_bytes().alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(2 * partitions(docs.sparkSession), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return materialize(ordered.mapInPandas(encode, "part int, shard int, part_start long, n_tokens long, payload binary"), "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the shards' payloads, read by rank.

    The driver takes one number for each part, as many as the writer had tasks.
    """
    spark = shards.sparkSession
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, payload in zip(pdf["start"], pdf["payload"]):
                shard = Shard(payload)
                at = shard.first
                ids = memoryview(np.concatenate([shard.at(np.arange(a, min(a + AT_ONCE, shard.n_ids))) for a in range(0, shard.n_ids, AT_ONCE)]).astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, dtype="Int64"), "start": start + at[:-1], "n_tokens": np.diff(at), "ids_crc32": np.array(crc, dtype=np.int64)})

    base_rows = spark.createDataFrame(bases, "part int, base long")
    rows = shards.join(F.broadcast(base_rows), "part").select((F.col("base") + F.col("part_start")).alias("start"), "payload")
    return rows.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, position) with token, the id at that position (from 0) of the document; null where there is none.

    Ids that repeat in the shards give a row for each of their documents. A null doc_id or position finds nothing. Rows of wanted that
    repeat are answered once each; its other columns are not read. Only shards that are asked for are opened, and there only what ranks
    lead to. A document that is asked for very often is no hot group: its requests stream past its shard.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, number, payload in zip(pdf["part"], pdf["shard"], pdf["payload"]):
                shard = Shard(payload)
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, dtype="Int64"), "part": part, "shard": number, "first": shard.first[:-1], "n": np.diff(shard.first)})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = key = None
        for pdf in batches:
            for own, rows in pdf.groupby(["part", "shard"], sort=False):
                given = rows["payload"].notna().to_numpy()
                if given.any():  # the shard's own row comes before its requests
                    shard, key = Shard(rows["payload"].iloc[int(given.argmax())]), own
                assert key == own
                asked = rows[~given]
                if len(asked):
                    yield pd.DataFrame({"doc_id": asked["doc_id"], "position": asked["position"], "token": shard.at((asked["first"] + asked["position"]).to_numpy()).astype(np.int64)})

    index = shards.select("part", "shard", "payload").mapInPandas(names, "doc_id long, part int, shard int, first long, n long")
    found = wanted.select("doc_id", "position").join(index, "doc_id").where("position >= 0 and position < n")
    asked = found.select("part", "shard", F.lit(1).alias("side"), "doc_id", "position", "first", F.lit(None).cast("binary").alias("payload"))
    none = F.lit(0).cast("long")
    opened = shards.join(found.select("part", "shard").distinct(), ["part", "shard"]).select("part", "shard", F.lit(0).alias("side"), none.alias("doc_id"), none.alias("position"), none.alias("first"), "payload")
    dealt = opened.unionByName(asked).repartition("part", "shard").sortWithinPartitions("part", "shard", "side")
    got = dealt.mapInPandas(answer, "doc_id long, position long, token long").withColumnsRenamed({"doc_id": "_doc_id", "position": "_position"})
    missed = wanted.select("doc_id", "position").join(found.select(F.col("doc_id").alias("_doc_id"), F.col("position").alias("_position")).distinct(), (F.col("doc_id") == F.col("_doc_id")) & (F.col("position") == F.col("_position")), "left_anti")
    return got.select(F.col("_doc_id").alias("doc_id"), F.col("_position").alias("position"), "token").unionByName(missed.withColumn("token", F.lit(None).cast("long")))
