"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets come from weights, with an upper bound for each source. Blocks of BLOCK words go to sources by highest quotients, then within
each source to its shards in the same way, which gives an integer quota for each shard. A shard is a seeded hash bucket of a source's
documents; its documents, in seeded order, form a stream of words that is cut into blocks, and a seeded start spreads the quota's
blocks evenly over the stream. A document takes the words of its that lie in selected blocks, twice where the stream goes round twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, materialize, pick

BLOCK = 64
#: Least words of a shard, and about how many shards all sources have together at most (one more each), which bounds what the driver handles.
SHARD_WORDS = 200_000
MOST_SHARDS = 1 << 16
MOST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20_240_601


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares total by weight; what is above most times a source's size is shared anew among the others, until none is above."""
    out, left, rest = [0.0] * len(sizes), float(total), [i for i in range(len(sizes)) if sizes[i] > 0]
    while rest:
        unit = left / sum(weights[i] for i in rest)
        full = [i for i in rest if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in rest:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        rest = [i for i in rest if i not in set(full)]
    return out


def apportion(weights: Sequence[float], most: Sequence[int], seats: int) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest weight / (2 * seats so far + 1), within most; ties to the smaller index.

    A divisor is found by halving such that rounding gives at most the seats; the few that are left go by quotients, so the work
    follows the number of weights, not of seats.
    """
    seats = min(seats, sum(m for w, m in zip(weights, most) if w > 0))
    if seats <= 0:
        return [0] * len(weights)

    def at(divisor: float) -> list[int]:
        return [min(m, int(w / divisor + 0.5)) for w, m in zip(weights, most)]

    low, high = min(w for w in weights if w > 0) / (2 * max(most) + 2), 4.0 * sum(weights)
    for _ in range(300):
        mid = (low + high) / 2 if high < 4 * low else (low * high) ** 0.5
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(at(mid)) > seats else (low, mid)
    out = at(high)
    heap = [(-w / (2 * n + 1), i) for i, (w, n, m) in enumerate(zip(weights, out, most)) if n < m and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _chosen(blocks: Column, quota: Column, of: Column, start: Column) -> Column:
    """How many of the first blocks of a stream are selected when quota of its blocks are, spread evenly from a start."""
    return F.floor((blocks + start) * quota / of) - F.floor(start * quota / of)


def _taken(words: Column, block: int, quota: Column, of: Column, start: Column) -> Column:
    whole = F.floor(words / block)
    before = _chosen(whole, quota, of, start)
    inside = _chosen(whole + 1, quota, of, start) - before
    return before * block + inside * (words - whole * block)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of docs.

    size: words in the text (null: 0). weights repeat over the sources in code point order, a null source last. A document without
    words takes none. Rows that repeat a doc_id are taken one by one; equal rows may swap places, which changes no result. An empty
    table gives no rows. Texts are counted whole, however long. Other columns are not read, whatever their names. The driver handles a row for each source (MOST_SOURCES, else ValueError) and for
    each shard: shards have shard_words, or more where MOST_SHARDS of that size would not hold all words.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The order within a stream: by the seed and the row's own contents, so reruns agree.
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = sorted(((r["source"], r["size"]) for r in found), key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    sizes = [n for _, n in sources]
    own = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share * sum(sizes), most)
    bound = max(1, int(most))
    quotas = apportion(own, [bound * -(-n // block) for n in sizes], round(sum(own) / block))
    shard_words = max(shard_words, -(-sum(sizes) // MOST_SHARDS))
    plan = [(s, n, t, q, max(1, -(-n // shard_words))) for (s, n), t, q in zip(sources, own, quotas)]
    source_rows = spark.createDataFrame(plan, "_source string, source_size long, target double, source_quota long, shards int")
    # One row for each source of a bounded number.
    dealt = sized.join(F.broadcast(source_rows), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards").cast("long")).cast("int"))
    shard_sizes = dealt.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).collect()
    by: dict[str | None, list[tuple[int, int]]] = {}
    for r in shard_sizes:
        by.setdefault(r["source"], []).append((r["shard"], r["shard_size"]))
    shard_plan = []
    for source, _, _, quota, _ in plan:
        own_shards = sorted(by.get(source, []))
        blocks = [-(-n // block) for _, n in own_shards]
        for (shard, n), b, q in zip(own_shards, blocks, apportion([n for _, n in own_shards], [bound * b for b in blocks], quota)):
            shard_plan.append((source, shard, b, q // b, q % b))
    shard_rows = spark.createDataFrame(shard_plan, "_source string, _shard int, blocks long, rounds long, quota long")
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    some = dealt.where("size > 0").withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    some = some.join(F.broadcast(shard_rows), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))
    args = (block, F.col("quota"), F.col("blocks"), start)
    taken = F.col("rounds") * F.col("size") + _taken(F.col("at") + F.col("size"), *args) - _taken(F.col("at"), *args)
    columns = ["doc_id", "size", "source_size", "target"]
    full = some.select(*columns, "source", taken.cast("long").alias("taken"))
    none = dealt.where("size = 0").select(*columns, "source", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none)


def copies(taken: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source and times, how many whole copies stand for the words that mix took; ids with none are left out.

    Rows of a source that share a doc_id, or have none, go together. Each source is dealt into shards by doc_id; in a shard, by size, the
    running sum of taken / size is cut at the whole numbers after a seeded start. So a document's mean number of copies is taken / size,
    and a shard's copies have its taken words within the words of its largest document.
    """
    whole = taken.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max("source_size").alias("source_size")).where("taken > 0")
    shards = F.ceil(F.col("source_size") / shard_words).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id")
    # In units of a 2^30th, so that sums are exact.
    whole = whole.select("doc_id", "source", "size", draw.alias("draw"), F.pmod(F.xxhash64(draw), shards).alias("shard"), F.expr("taken * 1073741824L div size").alias("share"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.lit(1 << 30))
    stream = Window.partitionBy("source", "shard").orderBy("size", "draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("share").over(stream) + start
    times = F.shiftright(upto, 30) - F.shiftright(upto - F.col("share"), 30)
    return whole.select("doc_id", "source", times.cast("int").alias("times")).where("times > 0")
