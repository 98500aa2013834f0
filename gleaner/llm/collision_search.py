"""Nearest neighbours by collision counting.

Each vector has one projection on each of many random directions. In a block of vectors every direction keeps its projections sorted.
A query's window in each, centred on its own projection, grows with a radius (virtual rehashing: a wider window is the coarser bucket of
the same hash, so only what is new is counted), and every vector counts the windows it is in. A vector at the radius itself is in a
window with probability INSIDE, one at WIDER times the radius with less; the collision threshold lies between the two counts that are to be
expected, SLACK deviations below the first, and vectors that reach it are verified by their exact distance. A query is done with a block when
its k-th best distance there is within APART times the radius, or all vectors are verified: an approximate stop, whose recall is measured.

Queries meet the data block by block. A block's vectors come first and are indexed once; the queries then stream past the index. The best
of each block are merged. Blocks bound memory, whatever the number of vectors or queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, partitions
from gleaner.llm.vectors import clean, matrix

DIRECTIONS = 128
#: P(|N(0, 1)| < 1); deviations below its expected count that a vector at the radius may fall; and the approximation of the stop.
INSIDE, SLACK, APART = 0.6827, 1.6, 1.04
#: The radius grows by the first factor while no vector comes near the threshold, then by the second.
COARSE, FINE, NEAR = 1.4, 1.06, 0.75
BLOCK = 16384
SEED = 5


def threshold(directions: int = DIRECTIONS) -> int:
    """The collisions that a vector needs to be verified."""
    return max(1, math.ceil(directions * INSIDE - SLACK * math.sqrt(directions * INSIDE * (1 - INSIDE))))


class Index:
    """One block's sorted projections."""

    def __init__(self, x: np.ndarray, directions: int = DIRECTIONS, seed: int = SEED):
        self.x, self.m = x, directions
        self.axes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], directions))
        values = x @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.ravel()
        sorted_ = np.sort(values, axis=0).T
        # All directions in one ascending array: each has its own stretch, wide enough for any window.
        self.low, high = float(values.min()), float(values.max())
        self.width = max(high - self.low, 1e-12)
        self.lift = np.arange(directions) * (4 * self.width)
        self.flat = (np.clip(sorted_ - self.low, 0, self.width) + self.width + self.lift[:, None]).ravel()
        self.first = max(0.05 * float(values.std()), 1e-9 * self.width)
        self.enough = threshold(directions)

    def nearest(self, q: np.ndarray, ids: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Indices and distances of the k best found, by distance and then id, and how many were verified; skip: an index that is the query itself."""
        n = len(self.x)
        centre = (q @ self.axes) - self.low + self.width + self.lift
        edge_low, edge_high = self.lift, self.lift + 4 * self.width
        count = np.zeros(n, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        if skip is not None:
            seen[skip] = True
        low = high = np.searchsorted(self.flat, np.clip(centre, edge_low, edge_high))
        best, far, verified = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        radius = self.first
        while True:
            a = np.searchsorted(self.flat, np.maximum(centre - radius, edge_low))
            b = np.searchsorted(self.flat, np.minimum(centre + radius, edge_high - 0.5 * self.width), "right")
            a, b = np.minimum(a, low), np.maximum(b, high)
            # What each window has more on its left and on its right.
            new = [self.order[x:y] for x, y in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()]) if x < y]
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            low, high = a, b
            fresh = np.flatnonzero((count >= self.enough) & ~seen)
            if len(fresh):
                seen[fresh] = True
                verified += len(fresh)
                d = self.x[fresh] - q
                best, far = np.r_[best, fresh], np.r_[far, np.sqrt(np.einsum("ij,ij->i", d, d))]
                if len(best) > k:
                    top = np.lexsort((ids[best], far))[:k]
                    best, far = best[top], far[top]
            if len(best) >= k and far.max() <= APART * radius or seen.all():
                break
            if skip is not None:
                count[skip] = 0
            radius *= COARSE if count.max() < NEAR * self.enough else FINE
        top = np.lexsort((ids[best], far))
        return best[top], far[top], verified


def _meet(k: int):
    """Rows by block: its vectors (side 0, by vec_id), then the queries (side 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, index, ids = None, [], None, np.zeros(0, dtype=np.int64)
        for pdf in batches:
            for own, rows in pdf.groupby(["dim", "block"], sort=False):
                if own != key:
                    key, held, index = own, [], None
                asks = rows["side"].to_numpy() == 1
                if not asks.all():
                    held.append(rows[~asks])
                if not asks.any() or not held and index is None:
                    continue
                if index is None:
                    data = pd.concat(held, ignore_index=True)
                    ids, index, held = data["vec_id"].to_numpy(), Index(matrix(data["embedding"])), []
                queries, out = rows[asks], []
                for query, vector in zip(queries["vec_id"], matrix(queries["embedding"])):
                    at = int(np.searchsorted(ids, query))
                    found, score, n = index.nearest(vector, ids, k, at if at < len(ids) and ids[at] == query else None)
                    out.append((np.full(len(found), query), ids[found], score, np.r_[n, np.zeros(len(found) - 1, dtype=np.int64)] if len(found) else np.zeros(0, np.int64)))
                q, v, s, n = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s, "verified": n})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, verified: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found to each row where is_query holds.

    vectors: vec_id, embedding. A query is no candidate for itself. Equal distances rank by vec_id. Vectors that are null, zero, or
    hold null or non-finite components, and rows without a vec_id, take no part; vectors meet only those of their own length. Of rows
    that repeat a vec_id one stays, with the smallest components. An empty table, or no query, gives no rows. verified: also how many
    vectors the query was held against exactly, those of all blocks together.
    """
    n = partitions(vectors.sparkSession)
    rows = materialize(clean(vectors).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("v")).select("vec_id", "v.*"), "vectors")
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    data = rows.select("dim", own.alias("block"), F.lit(0).alias("side"), "vec_id", "embedding")
    asked = rows.where(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "embedding")
    met = data.unionByName(asked).repartition(max(2 * n, min(blocks, 100 * n)), "dim", "block").sortWithinPartitions("dim", "block", "side", "vec_id")
    found = met.mapInPandas(_meet(k), "query_id long, vec_id long, score double, verified long")
    if verified:
        found = materialize(found, "neighbours")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out.join(found.groupBy("query_id").agg(F.sum("verified").alias("verified")), "query_id") if verified else out
