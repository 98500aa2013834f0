"""A trie of conversations by their common openings.

Conversations are dealt by the digest of their first turn, and each task builds the tries of its first turns as dictionaries of pointers:
a node's number and a turn's number lead to the next node. Nodes are numbered as they are made, parents before children, so sums over
subtrees are taken by walking the numbers backwards, which meets every child before its parent, without recursion.

A first turn with too many rows for one task is dealt anew by its next turns, and so on, until what is below a node fits. The nodes
above, the spine, are made by plain sums over their rows. How much lies below every prefix of the conversations in question is one count, so a common
opening of a thousand turns takes one round, not a thousand; sums over the spine's subtrees take pointer doubling, as many rounds as the
logarithm of its depth. The root, without a turn, is always spine.

A turn is known by the SHA-256 of its role and text, and a prefix by that of the prefix before and the turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drop, materialize, pick, small_batches
from gleaner.llm.held import forget
from gleaner.operators.positions import positions

#: Turns below one first turn, or later prefix, that a task builds at most; and into how many parts all turns go at least.
GROUP_TURNS = 200_000
FEWEST_GROUPS = 256
#: Conversation ids that are joined to one text before they are hashed.
IDS_AT_ONCE = 4096
LENT = 9  # a conversation borrows fewer turns than this
FAMILY = 5
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation (conv_id, t: its number of turns), and its turns (conv_id, d from 1, turn: a digest, bytes of text).

    Conversation c is the first h turns of c - c % 5, then its own after its first h; h is crc32 of c in decimal, modulo 9. Turns are put in order by
    turn, null first; rows of one turn by role, then by digest, and rows that repeat are turns of their own. Null role and text are
    empty; rows without a conv_id are left out; % is SQL's, with the sign of c. Only digests and lengths are shuffled, never texts.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said("role")).cast("string"), F.lit(":"), said("role"), said("text")).cast("binary"), 256))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("nth"), said("role").alias("role"), digest.alias("turn"), F.octet_length(said("text")).cast("long").alias("bytes"))
    placed = materialize(positions(turns, ["nth", "role", "turn"], ["conv_id"]).select("conv_id", "pos", "turn", "bytes"), "turns")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    asked = sizes.select("conv_id", "n", h.alias("h"), base.alias("base")).join(there, "base", "left")
    asked = asked.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    asked = materialize(asked, "conversations")
    own = placed.join(asked, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("d"), "turn", "bytes")
    lender = placed.where(F.col("pos") < LENT - 1).withColumnRenamed("conv_id", "base")
    borrowed = lender.join(asked, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "turn", "bytes")
    out = materialize(own.unionByName(borrowed), "rebuilt")
    drop(placed)
    return asked.select("conv_id", (F.col("lent") + F.col("own")).alias("t")), out


def ends(rows: DataFrame) -> DataFrame:
    """prefix and ends_sha256 of rows (prefix, conv_id): of the ids in decimal, ascending, joined by commas. A list is dealt over tasks by
    ranges of ids and written there in long pieces, so that the task that hashes it, in order, streams few rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for pdf in batches:
            for prefix, c in zip(pdf["prefix"], pdf["conv_id"]):
                if held is None or held[0] != prefix or len(held[1]) >= IDS_AT_ONCE:
                    if held:
                        yield pd.DataFrame({"prefix": [held[0]], "first": held[1][:1], "ids": [",".join(map(str, held[1]))]})
                    held = (prefix, [])
                held[1].append(c)
        if held:
            yield pd.DataFrame({"prefix": [held[0]], "first": held[1][:1], "ids": [",".join(map(str, held[1]))]})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefix, sha = None, None
        for pdf in batches:
            for p, ids in zip(pdf["prefix"], pdf["ids"]):
                if sha is not None and p == prefix:
                    sha.update(b",")
                else:
                    if sha is not None:
                        yield pd.DataFrame({"prefix": [prefix], "ends_sha256": [sha.hexdigest()]})
                    prefix, sha = p, hashlib.sha256()
                sha.update(ids.encode())
        if sha is not None:
            yield pd.DataFrame({"prefix": [prefix], "ends_sha256": [sha.hexdigest()]})

    pieces = rows.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInPandas(write, "prefix binary, first long, ids string")
    return pieces.repartition("prefix").sortWithinPartitions("prefix", "first").mapInPandas(digest, "prefix binary, ends_sha256 string")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tries of a task: rows (top, above, base, conv_id, d, turn, bytes, t); a top is a subtrie's own digest, and its turn has depth base."""
    turn, _ = pd.factorize(pdf["turn"])
    top, tops = pd.factorize(pdf["top"])
    above = pdf.groupby(top)["above"].first()
    many = int(turn.max()) + 1
    order = np.lexsort((pdf["d"].to_numpy(), pdf["conv_id"].to_numpy()))
    conv, d, t, size = (pdf[c].to_numpy()[order].tolist() for c in ("conv_id", "d", "t", "bytes"))
    turn, top = turn[order].tolist(), top[order].tolist()
    heads: dict[int, int] = {}
    pointers: dict[int, int] = {}
    parent, depth, convs, least, length, ended, head = [], [], [], [], [], [], []
    node, last = -1, None
    for c, at, total, b, x, k in zip(conv, d, t, size, turn, top):
        if c != last:
            found, up, last = heads.get(k), -1, c
        else:
            up = node
            found = pointers.get(up * many + x)
        if found is None:
            found = len(parent)
            if up < 0:
                heads[k] = found
            else:
                pointers[up * many + x] = found
            parent.append(up)
            depth.append(at)
            convs.append(0)
            least.append(c)  # conversations come by id, so the first is the smallest
            length.append(b)
            ended.append(None)
            head.append(k if up < 0 else -1)
        node = found
        convs[node] += 1
        if at == total:
            if ended[node] is None:
                ended[node] = [c]
            else:
                ended[node].append(c)
    n = len(parent)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * length[i]
        if parent[i] >= 0:
            children[parent[i]] += 1
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    return pd.DataFrame({
        "conv_id": least, "depth": depth, "parent_conv_id": pd.array([least[p] if p >= 0 else None for p in parent], dtype="Int64"), "n_convs": convs, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else _EMPTY for e in ended],
        "above": [above[k] if k >= 0 else None for k in head],
    })


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns by conversation and depth, with prefix and above, the digests of all turns so far and of those before this one."""
    last, prefix = None, b""
    for pdf in batches:
        prefixes, aboves = [], []
        for c, d, turn in zip(pdf["conv_id"], pdf["d"], pdf["turn"]):
            above = b"" if c != last else prefix
            prefix = turn if d == 1 else hashlib.sha256(above + turn).digest()
            last = c
            prefixes.append(prefix)
            aboves.append(above)
        yield pdf.assign(prefix=prefixes, above=aboves)


def _spine(nodes: DataFrame) -> DataFrame:
    """nodes (prefix, above: null under the root, leaves, saved) with sums over the subtree of each."""
    s = materialize(nodes, "spine")
    while not s.where("above is not null").isEmpty():
        more = s.where("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = s.select(F.col("prefix").alias("above"), F.col("above").alias("higher"))
        out = s.join(more, "prefix", "left").join(up, "above", "left")
        out = out.select("prefix", F.col("higher").alias("above"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        before, s = s, materialize(out, "spine")
        drop(before)
    return s


def trie(conversations: DataFrame, group_turns: int = GROUP_TURNS, fewest_groups: int = FEWEST_GROUPS) -> DataFrame:
    """A row for each distinct sequence of first d turns (role, text) of the rebuilt conversations, d from 0: see rebuilt for these.

    conv_id (the smallest member; with depth it names the node), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves and saved_tokens (over the subtree: nodes without children; members less one times bytes of the last text), ends_sha256 (of the ids that
    end there). Texts are told apart whole, by SHA-256, however long. A conversation without turns is a member of the root alone. An
    empty table has no conversations, so no root and no rows. Other columns of the input are ignored, whatever their names.
    """
    small_batches(conversations.sparkSession)
    asked, turns = rebuilt(conversations)
    heads = turns.where("d = 1").select("conv_id", F.col("turn").alias("top"))
    convs = asked.join(heads, "conv_id", "left")
    sizes = materialize(convs.groupBy("top").agg(F.sum("t").alias("below"), F.count("*").alias("n"), F.min("conv_id").alias("least")), "first-turns")
    total, n_convs, least = sizes.agg(F.coalesce(F.sum("below"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.min("least")).first()
    if not n_convs:
        return conversations.sparkSession.createDataFrame([], _NODE)
    limit = max(1, min(group_turns, total // fewest_groups))
    groups = max(fewest_groups, -(-total // group_turns))
    known = convs.where("t > 0").join(sizes.select("top", (F.col("below") > limit).alias("large")), "top").select("conv_id", "t", "top", "large")
    rows = materialize(turns.join(known, "conv_id"), "trie-turns")
    drop(turns)
    parts = [rows.where("not large").select("top", F.lit(b"").alias("above"), "conv_id", "d", "turn", "bytes", "t")]
    # First turns with too much below them: what is below each of their prefixes tells where they are parted.
    long = rows.where("large").repartition("conv_id").sortWithinPartitions("conv_id", "d").select("conv_id", "d", "turn", "bytes", "t")
    chained = materialize(long.mapInPandas(_chained, "conv_id long, d long, turn binary, bytes long, t long, prefix binary, above binary"), "prefixes")
    below = chained.groupBy("prefix").agg(F.sum(F.col("t") - F.col("d") + 1).alias("below"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("bytes").alias("bytes"), F.min("d").alias("d"), F.min("above").alias("above"))
    spine = materialize(below.where(F.col("below") > limit).drop("below"), "spine-nodes")
    told = materialize(chained.join(spine.select("prefix", F.lit(True).alias("on_spine")), "prefix", "left").withColumn("on_spine", F.coalesce("on_spine", F.lit(False))), "parted")
    cut = told.where("on_spine").groupBy("conv_id").agg(F.max("d").alias("cut"))
    rest = told.where("not on_spine").join(cut, "conv_id").where("d > cut")
    tops = rest.where("d = cut + 1").select("conv_id", F.col("prefix").alias("top"), F.col("above").alias("top_above"))
    parts.append(rest.join(tops, "conv_id").select("top", F.col("top_above").alias("above"), "conv_id", "d", "turn", "bytes", "t"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        return _build(pdf)

    dealt = parts[0].unionByName(parts[1]).withColumn("part", F.pmod(F.xxhash64("top"), F.lit(groups)))
    built = materialize(dealt.groupBy("part").applyInPandas(build, f"{_NODE}, above binary"), "nodes")
    # Nodes under the spine, summed by the node above them.
    under = built.where("above is not null").groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    under = materialize(under.select(F.col("above").alias("prefix"), "children", "leaves", "saved"), "under-spine")
    inner = spine.groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("inner"))
    nodes = materialize(spine.join(under, "prefix", "left").join(inner, "prefix", "left").withColumn("n_children", F.coalesce("children", F.lit(0)) + F.coalesce("inner", F.lit(0))), "spine-children")
    own = nodes.select(
        "prefix", F.when(F.col("d") > 1, F.col("above")).alias("above"), F.coalesce("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    sums = _spine(own)
    ended = told.where("on_spine and d = t").select("prefix", "conv_id").unionByName(asked.where("t = 0").select(F.lit(b"").alias("prefix"), "conv_id"))
    hashes = materialize(ends(ended), "ends")
    first = nodes.where("d = 1").join(sums, "prefix").agg(F.count("*"), F.coalesce(F.sum(sums["leaves"]), F.lit(0)), F.coalesce(F.sum(sums["saved"]), F.lit(0))).first()
    shallow = under.where("octet_length(prefix) = 0").first()
    children, leaves, saved = (a + (b or 0) for a, b in zip(first, (shallow["children"], shallow["leaves"], shallow["saved"]) if shallow else (0, 0, 0)))
    root_ends = hashes.where("octet_length(prefix) = 0").first()
    root = [(least, 0, None, n_convs, children, leaves or 1, saved, root_ends["ends_sha256"] if root_ends else _EMPTY)]
    named = spine.select(F.col("prefix").alias("above"), F.col("least").alias("above_conv_id"))
    over = F.when(F.octet_length("above") == 0, F.lit(least)).otherwise(F.col("above_conv_id"))
    small = built.where("above is null or octet_length(above) = 0").withColumn("parent_conv_id", F.when(F.col("above").isNull(), F.col("parent_conv_id")).otherwise(F.lit(least))).drop("above")
    deep = built.where("octet_length(above) > 0").join(named, "above", "left").withColumn("parent_conv_id", F.col("above_conv_id")).drop("above", "above_conv_id")
    spined = nodes.select("prefix", "above", "least", "d", "n", "n_children").join(sums.select("prefix", "leaves", "saved"), "prefix").join(hashes, "prefix", "left").join(named, "above", "left").select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), over.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    drop(rows, chained)
    return small.unionByName(deep).unionByName(spined).unionByName(conversations.sparkSession.createDataFrame(root, _NODE))
