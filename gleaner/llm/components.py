"""Connected components of a graph by contraction, with joins and sums that Spark can split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i], the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """a, b: each node of the links ids[a[i]]-ids[b[i]] with the smallest that it reaches, where that is another."""
    nodes, flat = np.unique(np.r_[ids[a], ids[b]], return_inverse=True)
    root = local_roots(len(nodes), flat[: len(a)], flat[len(a) :])
    far = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[far], "b": nodes[root[far]]})


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that it reaches, for each node of an edge. edges: a, b, both long; nulls are left out.

    In each round every node points at its smallest neighbour, if that is smaller; four steps along the pointers are one; nodes that
    meet become one, and edges between what is left go on. Each round's tables are written to the shared folder. Sums are made before
    a shuffle, and joins are plain ones, whose large partitions Spark splits, so a node with very many edges is no bottleneck.
    """
    current = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    stars = []
    while not current.isEmpty():
        both = current.select(F.col("a").alias("node"), F.col("b").alias("next")).union(current.select("b", "a"))
        tree = materialize(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("next")), "tree")
        for _ in range(2):
            above = tree.select(F.col("node").alias("next"), F.col("next").alias("far"))
            tree = materialize(tree.join(above, "next").select("node", F.col("far").alias("next")), "tree")
        stars.append(tree)
        left = tree.select(F.col("node").alias("a"), F.col("next").alias("x"))
        right = tree.select(F.col("node").alias("b"), F.col("next").alias("y"))
        met = current.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        current = materialize(met.distinct(), "edges")
    if not stars:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = stars[0].select("node", F.col("next").alias("component"))
    for star in stars[1:]:
        step = star.select(F.col("node").alias("component"), F.col("next").alias("_next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    return out
