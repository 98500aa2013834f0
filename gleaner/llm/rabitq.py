"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

A unit vector is rotated at random; its code is the signs, its factor the inner product of the vector with its code's unit vector.
For another rotated vector q, <code, q> / factor is an unbiased estimate of their inner product, with a spread of
sqrt((1 - factor**2) / (factor**2 * (D - 1)) * (1 - cosine**2)). A pair whose estimate is so far below the threshold that a pair at the
threshold would hardly ever give it is dropped; all others are computed exactly.

Equal vectors are one node with a number of copies. Two passes keep the rest from growing with the square of a group. First, signs of several rotations make bucket keys; the pairs of a bucket
are estimated from codes, and a spanning forest of those that may link leaves each task. Its components hold every link that the buckets
found. Then each node goes once to its component, large components as pairs of blocks, and there pairs are estimated, recomputed, and
counted. Counts for each node and a spanning forest leave the task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drop, materialize, partitions, pick, settled
from gleaner.llm.components import components, forest
from gleaner.llm.grouping import whole_groups
from gleaner.llm.vectors import clean, matrix
from gleaner.llm.vectors import usable as valid
from gleaner.llm.words import mix, ragged

SEED = 11
#: Most links at the threshold that the buckets may miss, as a share; links above it are missed less.
MISS = 0.01
#: Spreads below the threshold at which an estimate drops a pair.
SPREADS = 4.0
#: Rows of a block: larger buckets and components are dealt out as pairs of blocks.
BLOCK = 1000
#: Already groups of more rows than this are dealt out, to so many blocks at most, as one task would do what several can.
SMALL, SPREAD = 128, 8
_PAIRS = 1 << 17


def shape(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of keys: buckets of about four unrelated vectors, and enough of them to miss little; one key for all to miss nothing."""
    if not miss:
        return 0, 1
    bits = min(40, max(4, round(math.log2(max(n, 2))) - 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1


@cache
def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix: the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, padded to a multiple of 64 columns."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotated vectors, their signs (+1, -1) and their factors."""
    turned = units @ rotation(units.shape[1], 0)
    signs = np.where(turned >= 0, 1, -1).astype(np.int8)
    return turned, signs, np.abs(turned).sum(1) / math.sqrt(units.shape[1])


def may_link(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float, rounding: np.ndarray | float = 0.0, spreads: float = SPREADS) -> np.ndarray:
    """For pairs, row by row: whether the estimate leaves a link possible. rounding: bound of the error in turned."""
    size = signs.shape[1]
    estimate = np.einsum("ij,ij->i", signs, turned, dtype=np.float64) / (math.sqrt(size) * factor)
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * (size - 1)) * (1 - threshold**2))
    return estimate + spreads * spread + rounding / factor >= threshold


def _keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    size = units.shape[1]
    turns = [units @ rotation(size, 1 + r) >= 0 for r in range(max(1, -(-bits * tables // size)))]
    flat = np.concatenate(turns, axis=1)[:, : bits * tables].reshape(len(units), tables, bits)
    value = (flat * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix(value * np.uint64(tables + 1) + np.arange(tables, dtype=np.uint64) + np.uint64(size << 48)).view(np.int64)


def _code_rows(bits: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("dim"):
                u = unit(matrix(part["embedding"]))
                turned, signs, factor = codes(u)
                step = np.abs(turned).max(1) / 127
                small = np.rint(turned / step[:, None]).astype(np.int8)
                packed = np.packbits(signs > 0, axis=1)
                # Rounded components, for which the bound of the error is half a step each.
                code = [a.tobytes() + b.tobytes() + np.array([f, s], dtype="<f8").tobytes() for a, b, f, s in zip(packed, small, factor, step)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "code": code, "keys": list(_keys(u, bits, tables))})

    return run


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of rows, some at a time."""
    many = np.repeat(starts + sizes, sizes) - np.arange(int(sizes.sum())) - 1
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        yield np.repeat(np.arange(at, stop), many[at:stop]), ragged(many[at:stop], np.arange(at, stop) + 1)
        at = stop


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.diff(np.r_[starts, len(key)])


def _candidates(threshold: float, spreads: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "bucket"):
            if len(pdf) < 2:
                continue
            starts, sizes = _runs(pdf["bucket"].to_numpy())
            ids, length = pdf["node"].to_numpy(), pdf["code"].map(len).to_numpy()
            found_a, found_b = [], []
            for n in np.unique(length):
                size = int(n - 16) * 8 // 9
                rows = np.flatnonzero(length == n)
                raw = np.frombuffer(b"".join(pdf["code"].iloc[rows]), dtype=np.uint8).reshape(len(rows), n)
                signs = np.unpackbits(raw[:, : size // 8], axis=1).astype(np.int8) * 2 - 1
                small = raw[:, size // 8 : size // 8 + size].view(np.int8)
                factor, step = np.ascontiguousarray(raw[:, -16:]).view("<f8").T
                own_starts, own_sizes = _runs(pdf["bucket"].to_numpy()[rows])
                for a, b in _pairs(own_starts, own_sizes):
                    dot = np.einsum("ij,ij->i", signs[a], small[b], dtype=np.int32) * step[b]
                    spread = np.sqrt(np.maximum(1 - factor[a] ** 2, 0) / (factor[a] ** 2 * (size - 1)) * (1 - threshold**2))
                    near = (dot / math.sqrt(size) + math.sqrt(size) * step[b] / 2) / factor[a] + spreads * spread >= threshold
                    found_a.append(rows[a[near]])
                    found_b.append(rows[b[near]])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if len(a):
                yield forest(ids, a, b)

    return run


def _exact(threshold: float, spreads: float):
    """Rows: bucket, of (the two blocks' numbers, one of which a row's is), node, copies, embedding. Out: counts (b null) and a forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "bucket"):
            starts, sizes = _runs(pdf["bucket"].to_numpy())
            ids, block, cross, copies = (pdf[c].to_numpy() for c in ("node", "block", "cross", "copies"))
            u = unit(matrix(pdf["embedding"]))
            turned, signs, factor = codes(u)
            count, found_a, found_b = np.zeros(len(pdf)), [], []
            for a, b in _pairs(starts, sizes):
                keep = ~cross[a] | (block[a] != block[b])
                a, b = a[keep], b[keep]
                keep = may_link(signs[a], factor[a], turned[b], threshold, 1e-9, spreads)
                a, b = a[keep], b[keep]
                keep = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                a, b = a[keep], b[keep]
                count += np.bincount(a, copies[b], minlength=len(count)) + np.bincount(b, copies[a], minlength=len(count))
                found_a.append(a)
                found_b.append(b)
            if not found_a:
                continue
            has = count > 0
            out = pd.DataFrame({"a": ids[has], "b": pd.array([None] * int(has.sum()), dtype="Int64"), "n": np.rint(count[has]).astype(np.int64)})
            trees = forest(ids, np.concatenate(found_a), np.concatenate(found_b))
            yield pd.concat([out, pd.DataFrame({"a": trees["a"], "b": trees["b"].astype("Int64"), "n": 0})], ignore_index=True)

    return run


def near_duplicates(vectors: DataFrame, threshold: float, miss: float = MISS, block: int = BLOCK, spreads: float = SPREADS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components, and rows without a vec_id, link with nothing. Vectors of
    different lengths do not link. Each row is a vector of its own: rows that repeat a vec_id link with each other as others do. An
    empty table gives no rows; other columns are not read. miss=0 leaves no link out, by estimating and computing all pairs of blocks:
    that grows with the square of the number of different vectors.
    """
    vectors = pick(vectors, "vec_id", "embedding")
    rows, n = clean(vectors), partitions(vectors.sparkSession)
    spreads = spreads if miss else math.inf

    def linked() -> DataFrame:
        nodes = rows.groupBy("dim", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
        nodes = materialize(nodes, "vectors")  # which also settles the nodes' numbers
        bits, tables = shape(nodes.count(), threshold, miss)
        coded = materialize(nodes.select("node", "dim", "embedding").repartition(2 * n).mapInPandas(_code_rows(bits, tables), "node long, code binary, keys array<long>"), "codes")
        keyed = coded.select("node", F.explode("keys").alias("key"))
        shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        full = coded.select("node", "code", F.explode("keys").alias("key")).join(shared, "key")
        dealt = full.select("node", "code", _dealt(F.col("key"), block)).select("node", "code", F.col("deal.bucket").alias("bucket"))
        trees = dealt.repartition(2 * n, "bucket").sortWithinPartitions("bucket").mapInPandas(_candidates(threshold, spreads), "a long, b long")
        groups = settled(lambda: components(trees), "candidates")
        counts = groups.groupBy("component").agg(F.count("*").alias("n"))
        sized = groups.join(counts, "component").select("node", F.col("component").alias("key"), "n")
        members = nodes.join(sized, "node").select("node", "copies", "embedding", _dealt(F.xxhash64("key", "dim"), block)).select("node", "copies", "embedding", "deal.*")
        exact = members.repartition(2 * n, "bucket").sortWithinPartitions("bucket").mapInPandas(_exact(threshold, spreads), "a long, b long, n long")
        found = materialize(exact, "links")
        drop(coded, shared, groups)
        links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
        named = components(found.where("b is not null").select("a", "b"))
        told = nodes.join(links, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        told = materialize(told.select("dim", "embedding", "vec_id", "component", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked-vectors")
        smallest = told.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        return told.drop("vec_id").join(smallest, "component").drop("component")

    told = settled(linked, "linked-vectors")  # read anew, so that Spark can split what a common vector joins
    usable = rows.join(told, ["dim", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~(F.col("vec_id").isNotNull() & valid(F.col("embedding").cast("array<double>"))))
    out = usable.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _dealt(key, block: int):
    """Copies of a row for the pairs of blocks of its key that its own block (by node) is in; n is the number of rows of the key."""
    n = F.col("n")
    blocks = F.greatest(F.ceil(n / block), F.least(F.lit(SPREAD), F.ceil(n / SMALL))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")

    def deal(other):
        low, high = F.least(own, other), F.greatest(own, other)
        return F.struct(F.xxhash64(key, low, high).alias("bucket"), own.alias("block"), (low != high).alias("cross"))

    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), deal)).alias("deal")
