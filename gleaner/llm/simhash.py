"""SimHash near-duplicates, with tables of distances to reference fingerprints.

Fingerprints that differ in at most RADIUS bits agree in at least two of five blocks, so each distinct fingerprint goes to ten
buckets, and the pairs of a bucket are weighed there: by pivot distance tables. The Hamming distances of each fingerprint to PIVOTS
are computed once; two fingerprints can be within RADIUS only if no coordinate differs by more. Rows are sorted by the first
coordinate, so only a window of it is looked at, the other coordinates discard nearly all that is left, and survivors are verified.
A bucket of more than HOT fingerprints is dealt out further by its other bits: twenty times, by three of six smaller blocks each time.
Of each bucket only a spanning forest of its links leaves the task.

That radius means nearly equal texts. similar() and keep_one() find texts by the similarity of their shingle sets instead: see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import drop, materialize, partitions, pick, settled, small_batches, text_bytes
from gleaner.llm.components import components, forest
from gleaner.llm.grouping import whole_groups
from gleaner.llm.held import forget, release
from gleaner.llm.words import lowered, mix, ragged, slices, words_of

SHINGLE = 5
RADIUS = 3
SEED = 42
HOT = 1000
#: For links by exact similarity: the least Jaccard similarity, the share of links that keys may miss a little beyond the expected
#: distance, and the rows of a bucket and of a block of a component that a task takes together.
SIMILARITY = 0.8
MISS = 0.02
CROWD, BLOCK = 8192, 1000
#: Bytes of shingle sets in a block, as its component has them on average.
BLOCK_BYTES = 16 << 20
#: Bits of the wide fingerprints that tell such texts from others, and one in how many rows is counted to find crowded buckets.
WIDE, SAMPLE = 128, 16
#: Texts of so few shingles that a link within SIMILARITY drops at most so many of either's are linked exactly, through what is left of them.
DROPS, MOST_FEW = 2, 64
#: Reference fingerprints, from a seed: random ones tell near pairs from others best.
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64)
_STEP = 1 << 17
_PAIRS = 1 << 20
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: XXH64 of its lower-case word shingles, bit by bit set where over half the shingles have it."""
    out = []
    for s in slices(texts):
        hashes, many, _ = _shingles(texts[s], shingle)
        out.append(_fingerprints(hashes, many))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all shingles, how many each text has, and 128 bits for all words of each text, as two columns."""
    w = words_of(texts)
    sizes = w.end - w.start
    # The words with one space after each.
    at = np.r_[0, np.cumsum(sizes + 1)].astype(np.int64)
    joined = lowered(w.buffer[ragged(sizes + 1, w.start)])
    joined[at[1:] - 1] = 32
    data = joined.tobytes()
    n = w.counts
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = ragged(shingles, w.first[:-1])
    last = np.minimum(first + shingle - 1, np.repeat(w.first[1:], shingles) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(first), dtype=np.uint64)
    for k in range(0, len(first), _STEP):
        a, b = at[first[k : k + _STEP]].tolist(), (at[last[k : k + _STEP] + 1] - 1).tolist()
        hashes[k : k + _STEP] = np.fromiter((digest(data[x:y], SEED) for x, y in zip(a, b)), dtype=np.uint64, count=len(a))
    ends = at[w.first]
    wide = xxhash.xxh3_128_digest
    whole = b"".join(wide(data[x:y], SEED + 1) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()))
    return hashes, shingles, np.frombuffer(whole, dtype=np.uint64).reshape(-1, 2)


def _fingerprints(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(shingles)), shingles)
    counts = np.zeros((len(shingles), 64), dtype=np.int64)
    for k in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[k : k + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[k : k + _STEP]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _sets(hashes: np.ndarray, shingles: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    return [np.unique(x) for x in np.split(hashes, np.cumsum(shingles)[:-1])]


def _masks(parts: list[int], together: int) -> list[int]:
    """Each choice of together of the parts (masks), as one mask; signed, as a long."""
    return [m - (m >> 63 << 64) for m in (sum(c) for c in combinations(parts, together))]


def _halves(start: int, n: int) -> list[int]:
    first = n // 2
    return [((1 << first) - 1) << start, ((1 << n - first) - 1) << start + first]


#: Start and bits of the five blocks; the masks of each two; and for each of these, masks of each three of the six halves of the others.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
COARSE = _masks([(1 << n) - 1 << start for start, n in BLOCKS], 2)
FINE = [_masks([h for block in BLOCKS if block not in two for h in _halves(*block)], 3) for two in combinations(BLOCKS, 2)]


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its distances to the pivots, a byte each."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :])


def pairs_within(groups: np.ndarray, prints: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a group whose fingerprints differ in at most radius bits, with their pivot_table. Pairs that the pivots discard are not weighed."""
    table = table.astype(np.int16)
    place = groups.astype(np.int64) * 128 + table[:, 0]
    order = np.argsort(place, kind="stable")
    place, table, prints = place[order], table[order], prints[order]
    many = np.searchsorted(place, place + radius, "right") - np.arange(len(place)) - 1
    ends = np.cumsum(many)
    out_a, out_b = [], []
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        a = np.repeat(np.arange(at, stop), many[at:stop])
        b = ragged(many[at:stop], np.arange(at, stop) + 1)
        for p in range(1, len(PIVOTS)):
            near = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        out_a.append(order[a[near]])
        out_b.append(order[b[near]])
        at = stop
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in whole_groups(batches, "bucket"):
        if len(pdf) < 2:
            continue
        groups = np.cumsum(np.r_[0, pdf["bucket"].to_numpy()[1:] != pdf["bucket"].to_numpy()[:-1]])
        table = np.frombuffer(b"".join(pdf["pivots"]), dtype=np.uint8).reshape(len(pdf), -1)
        a, b = pairs_within(groups, pdf["fp"].to_numpy().view(np.uint64), table)
        if len(a):
            yield forest(pdf["id"].to_numpy(), a, b)


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: a spanning forest of the links among distinct fingerprints (fp, id). Each one's distances to the pivots are computed once and go with it."""
    n = partitions(prints.sparkSession)

    def measure(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in column:
            yield pd.Series([x.tobytes() for x in pivot_table(series.to_numpy().view(np.uint64))], dtype=object)

    prints = materialize(prints.select("fp", "id", F.pandas_udf(measure, "binary")("fp").alias("pivots")), "pivots")
    coarse = F.posexplode(F.array(*map(F.lit, COARSE))).alias("choice", "mask")
    rows = prints.select("fp", "id", "pivots", coarse).select("fp", "id", "pivots", "choice", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(shared, "key"), "buckets")
    cold = rows.where(F.col("n") <= hot).select("fp", "id", "pivots", F.col("key").alias("bucket"))
    fine = F.posexplode(F.get(F.array(*[F.array(*map(F.lit, masks)) for masks in FINE]), F.col("choice"))).alias("finer", "mask")
    warm = rows.where(F.col("n") > hot).select("fp", "id", "pivots", "key", fine)
    warm = warm.select("fp", "id", "pivots", F.xxhash64("key", "finer", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    dealt = cold.unionByName(warm).repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and component_id, the smallest doc_id reachable by links, for each row of docs.

    Equal fingerprints link, those of empty and null texts too, which are zero. Rows that repeat a doc_id keep their own fingerprints
    and groups. A null doc_id gives way to any other in its group; a group of nulls has a null component. An
    empty table gives no rows. Texts are taken whole, however long. Other columns are not read, whatever their names.
    """

    docs = pick(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for series in column:
            yield pd.Series(fingerprints(series.tolist(), shingle).view(np.int64))
        release()

    rows = materialize(docs.select("doc_id", F.pandas_udf(run, "long")(text_bytes()).alias("fp")), "fingerprints")
    # Each fingerprint stands for its rows; its node in the graph is the fingerprint itself.
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("id"))
    prints = materialize(prints, "distinct-fingerprints")

    def name() -> DataFrame:
        found = components(links(prints.select("fp", "id")))
        return prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))

    named = settled(name, "named-fingerprints")
    drop(prints)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_print = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def wide_shape(n: int, similarity: float, miss: float = MISS) -> tuple[int, int, int]:
    """For WIDE-bit fingerprints of texts whose shingle sets have a Jaccard similarity: most bits apart, bits of a key, and keys.

    Two sets of one size differ in a share acos(2s / (1 + s)) / pi of the bits, give or take a binomial spread. As many spreads are
    allowed for as leave out half of miss, and as many keys are made as leave out miss of what is 0.7 spreads beyond the expected distance.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = math.sqrt(WIDE * apart * (1 - apart))
    bits = min(40, max(6, round(math.log2(max(n, 2))) - 6))
    same = (1 - (WIDE * apart + 0.7 * spread) / WIDE) ** bits
    allowed = NormalDist().inv_cdf(1 - miss / 2)
    return min(WIDE, int(WIDE * apart + allowed * spread)), bits, math.ceil(math.log(miss) / math.log(1 - same)) if same < 1 else 1


def pairs_wide(groups: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a group (in runs) whose two words differ in at most radius bits together, as long as radius is wide.

    Of distances to pivots only those of the first word to one pivot are used, as a window: at such a radius hardly a pair is discarded,
    and further coordinates would cost more than the weighing that they spare.
    """
    place = groups.astype(np.int64) * 256 + np.bitwise_count(low ^ PIVOTS[0])
    order = np.argsort(place, kind="stable")
    place, low, high = place[order], low[order], high[order]
    many = np.searchsorted(place, place + radius, "right") - np.arange(len(place)) - 1
    ends = np.cumsum(many)
    out_a, out_b, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        a, b = np.repeat(np.arange(at, stop), many[at:stop]), ragged(many[at:stop], np.arange(at, stop) + 1)
        first = np.bitwise_count(low[a] ^ low[b])
        near = first <= radius
        a, b, first = a[near], b[near], first[near]
        near = first + np.bitwise_count(high[a] ^ high[b]) <= radius
        out_a.append(order[a[near]])
        out_b.append(order[b[near]])
        at = stop
    return np.concatenate(out_a), np.concatenate(out_b)


def _words(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = pdf["bucket"].to_numpy()
    return np.cumsum(np.r_[0, key[1:] != key[:-1]]), pdf["fp"].to_numpy().view(np.uint64), pdf["fp2"].to_numpy().view(np.uint64)


def _near(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "bucket"):
            if len(pdf) > 1:
                a, b = pairs_wide(*_words(pdf), radius)
                yield forest(pdf["node"].to_numpy(), a, b)

    return run


def _alike(radius: int, similarity: float):
    """In blocks of a component: a spanning forest of the pairs whose shingle sets are similar enough, each held against the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "bucket"):
            node, block, cross = (pdf[c].to_numpy() for c in ("node", "block", "cross"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
            sizes = np.array([len(x) for x in sets])
            a, b = pairs_wide(*_words(pdf), radius)
            may = (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])) & (node[a] != node[b]) & (~cross[a] | (block[a] != block[b]))
            a, b = a[may], b[may]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else np.zeros(1, np.int64)
            root = np.arange(len(pdf))
            out = [np.zeros((0, 2), dtype=np.int64)]
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x = int(a[start])
                others = b[start:stop]
                others = others[root[others] != root[x]]  # the rest are linked already, over others
                near = others[_similar_to(sets[x], [sets[y] for y in others], similarity)]
                # One link to each group that is not yet its own.
                near = near[np.unique(root[near], return_index=True)[1]]
                if len(near):
                    out.append(np.stack([np.full(len(near), node[x]), node[near]], axis=1))
                    root[np.isin(root, root[near])] = root[x]
            out = np.concatenate(out)
            yield pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


def _similar_to(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of others' sets has that Jaccard similarity to own, all of them sorted; as many at once as bound the memory."""
    sizes = np.array([len(x) for x in others], dtype=np.int64)
    shared = np.zeros(len(others), dtype=np.int64)
    if not len(own):
        return sizes == 0
    batches = np.cumsum(sizes) // _STEP
    for batch in np.unique(batches):
        which = np.flatnonzero((batches == batch) & (sizes > 0))
        if len(which):
            flat = np.concatenate([others[i] for i in which])
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared[which] = np.add.reduceat(found, np.cumsum(sizes[which]) - sizes[which], dtype=np.int64)
    return shared >= similarity * (len(own) + sizes - shared)


def few_shingles(similarity: float) -> int:
    """The most distinct shingles of a text that is linked through its cores: a similar text lacks at most DROPS of them."""
    n = DROPS
    while n < MOST_FEW and not n + 1 - (DROPS + 1) >= similarity * (n + 1):
        n += 1
    return n


def _cores(similarity: float, few: int):
    """key, key2, core, level, node: two sums over each text's shingles, and for texts of few also without any choice of level of them, as long as the core that is left can be similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, size = pdf["node"].to_numpy(), pdf["size"].to_numpy()
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                parts = np.frombuffer(b"".join(pdf["few"].iloc[own]), dtype=np.uint64).reshape(len(own), -1)
                # Texts of more come with their two sums alone.
                both = (parts, mix(parts + _OTHER)) if n <= few else (parts[:, :1], parts[:, 1:])
                total, total2 = (x.sum(axis=1, dtype=np.uint64) for x in both)
                for level in range(n + 1 if n <= few else 1):
                    if n - level < similarity * n:
                        break
                    for out in combinations(range(n), level) if level else [()]:
                        key, key2 = (t - x[:, list(out)].sum(axis=1, dtype=np.uint64) for t, x in zip((total, total2), both))
                        yield pd.DataFrame({"key": key.view(np.int64), "key2": key2.view(np.int64), "core": np.int32(n - level), "level": np.int32(level), "node": node[own]})

    return run


def links_of_few(prints: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all texts of few_shingles or fewer that are similar, and all texts with equal sets, from prints' node, size and few.

    Two sets are similar if both have a core whose share in their union is large enough. Of the texts of a core the one that drops least
    is linked with each other one that is similar to it; two that are similar to each other both are, since it drops no more than either.
    """
    cores = materialize(prints.select("node", "size", "few").mapInPandas(_cores(similarity, few_shingles(similarity)), "key long, key2 long, core int, level int, node long"), "cores")
    hubs = cores.groupBy("key", "key2", "core").agg(F.min(F.struct("level", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "key2", "core", "hub")
    hubs = materialize(hubs, "core-hubs")  # read anew, so that Spark can split a common core in the join
    near = F.col("core") >= F.lit(float(similarity)) * (F.col("core") + F.col("level") + F.col("hub.level"))
    return cores.join(hubs, ["key", "key2", "core"]).where(near & (F.col("node") != F.col("hub.node"))).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """A row for each text, which text1 and text2 tell apart, with its smallest doc_id, and node, its name in the graph: text1, but where
    several texts share that, another hash for all of them but one."""
    found = rows.groupBy("text1", "text2").agg(*[F.min(c).alias(c) for c in ("doc_id", "fp", "fp2", "size", "few")])
    shared = F.min("text2").over(Window.partitionBy("text1")) < F.col("text2")
    return found.select("*", F.when(shared, F.xxhash64("text1", "text2")).otherwise(F.col("text1")).alias("node"))


def similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """doc_id and component_id, as near_duplicates has them, where texts link if their sets of shingles have at least that Jaccard similarity.

    Fingerprints, of the distinct shingles, only find candidates here, by keys of random bits and a wide radius: see wide_shape for what
    these may miss; miss can be made as small as is asked for (not 0), at the price of more keys: their number follows its logarithm.
    At this radius distances to pivots hardly discard a pair; only one is used, as a window. Candidates are then held against each other exactly, each component in blocks, so a link that is given is always one.
    A text is known by 128 bits of its words, its set by two sums of 64. Texts with equal sets and those of few shingles, whose fingerprints say little, are linked exactly without: see links_of_few.
    """
    n = partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    few = few_shingles(similarity)

    def run(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for series in column:
            texts, parts, sizes, left = series.tolist(), [], [], []
            for s in slices(texts):
                hashes, many, whole = _shingles(texts[s], shingle)
                own = _sets(hashes, many)
                hashes, many = np.concatenate(own), np.array([len(x) for x in own])
                with np.errstate(over="ignore"):
                    other = mix(hashes + _OTHER)
                    sums = np.split(mix(other), np.cumsum(many)[:-1])
                parts.append((_fingerprints(hashes, many), _fingerprints(other, many), whole[:, 0], whole[:, 1]))
                sizes += many.tolist()
                left += [x.tobytes() if len(x) <= few else np.array([x.sum(), mix(x + _OTHER).sum()], dtype=np.uint64).tobytes() for x in sums]
            columns = [np.concatenate(x).view(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
            yield pd.DataFrame(dict(zip(("fp", "fp2", "text1", "text2"), columns)) | {"size": np.array(sizes, dtype=np.int32), "few": left})
        release()

    def sets(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for series in column:
            texts, out, nodes = series.tolist(), [], [np.zeros((0, 2), dtype=np.uint64)]
            for s in slices(texts):
                hashes, many, whole = _shingles(texts[s], shingle)
                out += [x.tobytes() for x in _sets(hashes, many)]
                nodes.append(whole)
            own = np.concatenate(nodes).view(np.int64)
            yield pd.DataFrame({"text1": own[:, 0], "text2": own[:, 1], "shingles": out})
        release()

    rows = docs.select("doc_id", F.pandas_udf(run, "fp long, fp2 long, text1 long, text2 long, size int, few binary")(text_bytes()).alias("v")).select("doc_id", "v.*")
    rows = materialize(rows, "fingerprints")

    def near(prints: DataFrame, radius: int, bits: int, tables: int) -> DataFrame:
        draw = np.random.default_rng(SEED)
        wide = [sum(1 << int(b) for b in draw.choice(WIDE, bits, replace=False)) for _ in range(tables)]
        halves = [[x - (x >> 63 << 64) for x in (m & (1 << 64) - 1, m >> 64)] for m in wide]
        choices = F.posexplode(F.array(*[F.struct(F.lit(a).alias("m"), F.lit(b).alias("m2")) for a, b in halves])).alias("choice", "mask")
        bits_of = F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask.m")), F.col("fp2").bitwiseAND(F.col("mask.m2")))
        keyed = prints.select("node", "fp", "fp2", choices).select("node", "fp", "fp2", bits_of.alias("key"))
        # Few buckets are crowded, which a sixteenth of the rows tells; only those are dealt out as pairs of blocks.
        counts = keyed.where(F.pmod("node", F.lit(SAMPLE)) == 0).groupBy("key").agg((F.count("*") * SAMPLE).alias("n"))
        crowded = materialize(counts.where(F.col("n") > CROWD), "crowded-buckets")
        spread = F.when(F.col("n").isNull(), F.array("key")).otherwise(_blocks_of("key", F.col("n"), CROWD)["bucket"])
        dealt = keyed.join(crowded, "key", "left").select("node", "fp", "fp2", F.explode(spread).alias("bucket"))
        dealt = dealt.repartition(2 * n, "bucket").sortWithinPartitions("bucket")
        return components(dealt.mapInPandas(_near(radius), "a long, b long"))

    def linked() -> DataFrame:
        prints = materialize(distinct_texts(rows), "distinct-texts")
        radius, bits, tables = wide_shape(prints.count(), similarity, miss)
        found = settled(lambda: near(prints, radius, bits, tables), "candidates")
        members = materialize(prints.join(found, "node").drop("few"), "members")
        # As many blocks as bound both the rows and the bytes of a pair of them.
        heavy = F.floor(F.sum(F.col("size").cast("long")) * 8 / BLOCK_BYTES) * BLOCK
        members = members.join(members.groupBy("component").agg(F.greatest(F.count("*"), heavy).alias("n")), "component").drop("size")
        own_sets = F.pandas_udf(sets, "text1 long, text2 long, shingles binary")(text_bytes()).alias("s")
        own = members.where("doc_id is not null").withColumnsRenamed({"text1": "own1", "text2": "own2"})
        texts = docs.select("doc_id", "text").join(own, "doc_id").select("node", "fp", "fp2", "component", "n", "own1", "own2", own_sets)
        texts = texts.where("s.text1 = own1 and s.text2 = own2").select("node", "fp", "fp2", "component", "n", "s.shingles")
        # Texts that only rows without a doc_id have are found by their hash.
        nameless = docs.where("doc_id is null").select(own_sets).select("s.*").join(members.where("doc_id is null").drop("doc_id"), ["text1", "text2"])
        texts = texts.unionByName(nameless.dropDuplicates(["node"]).select(texts.columns))
        texts = materialize(texts, "shingles")
        blocks = texts.select("node", "fp", "fp2", "shingles", F.explode(_blocks_of("component", F.col("n"), BLOCK)).alias("d")).select("node", "fp", "fp2", "shingles", "d.*")
        alike = blocks.repartition(2 * n, "bucket").sortWithinPartitions("bucket").mapInPandas(_alike(radius, similarity), "a long, b long")
        named = components(alike.unionByName(links_of_few(prints, similarity))).withColumnRenamed("component", "group")
        drop(found, texts)
        groups = prints.join(named, "node", "left").select("text1", "text2", "doc_id", F.coalesce("group", "node").alias("group"))
        groups = materialize(groups, "groups")
        smallest = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        return groups.join(smallest, "group").select("text1", "text2", "component_id")

    return rows.join(settled(linked, "texts"), ["text1", "text2"]).select("doc_id", "component_id")


def _blocks_of(key: str, n: Column, block: int) -> Column:
    """For a row of a key with n rows: the pairs of blocks, as bucket, in which its own block is; also that block, and whether the two differ."""
    count = F.greatest(F.ceil(n / block), F.least(F.lit(8), F.ceil(n / 128))).cast("int")
    own = F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")

    def deal(other: Column) -> Column:
        low, high = F.least(own, other), F.greatest(own, other)
        return F.struct(F.xxhash64(F.lit(1), key, low, high).alias("bucket"), own.alias("block"), (low != high).alias("cross"))

    return F.transform(F.sequence(F.lit(0), count - 1), deal)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """The rows of docs, one document of each group of similar ones: that with the smallest doc_id. A document is a doc_id: rows that
    repeat a kept one all stay, as do rows without one, though texts link through them. Null and empty texts are alike. An empty table
    has no rows; other columns stay as they are."""
    found = similar(docs, shingle, similarity, miss).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
