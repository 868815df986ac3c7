"""The prefix trie of conversations: a node for each distinct sequence of first turns, with rollups.

A conversation's first d turns are named by 128 bits: the exclusive or of hashes of (place, turn), so a
name takes one pass over turns in order, and blocks of a long conversation are named apart and joined.
Nodes are one aggregate by name. A node whose subtree has more than SHARD member turns is heavy; the
trie below the heavy ones falls into prefix shards of at most SHARD nodes. In tasks, runs of whole
shards become level-order unary degree sequences (LOUDS): a bit vector and arrays of labels in level
order, parents by counting zeros, rollups by `add.at` in reverse level order. The heavy upper levels are
merged apart: sums over ever farther descendants, doubled until no node has an ancestor that far."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, turn_to
from tessellum.llm.turns import in_order, positions

#: Member turns of a shard at most; nodes of a block of shards that is laid out at once, about.
SHARD = 1 << 16
#: Turns of a conversation whose names are made together.
STRETCH_BITS = 10
#: Ids of a text of ends that are joined before they are hashed.
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NAME = ["depth", "k1", "k2"]
MEASURES = ["n_children", "n_leaves", "saved_tokens"]


def louds(parent: np.ndarray) -> np.ndarray:
    """The bits of a forest whose nodes are in level order: for the super-root and then each node a one for each child
    and a zero. parent: the level-order number of each node's parent, -1 for the tops; it never falls."""
    bits = np.zeros(2 * len(parent) + 1, dtype=np.uint8)
    bits[np.arange(len(parent)) + parent + 1] = 1
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of each node: zeros before its one, less the super-root's."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones)) - 1


def degrees(bits: np.ndarray) -> np.ndarray:
    """Children of each node: ones between its zeros."""
    return np.diff(np.flatnonzero(bits == 0)) - 1


def level_order(names: np.ndarray, above: np.ndarray, depth: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of nodes by level, parent and name; their parents in that order, -1 for tops; where each level begins.

    names, above: rows (k1, k2) of a node and its parent; top: whether a node is the top of its shard."""
    n = len(names)
    both = np.concatenate((np.c_[depth, names], np.c_[depth - 1, above]))
    by = np.lexsort(both.T[::-1])
    new = np.r_[True, (both[by][1:] != both[by][:-1]).any(axis=1)]
    number = np.empty(2 * n, dtype=np.int64)
    number[by] = np.cumsum(new) - 1
    where = np.full(number.max() + 1, -1)
    where[number[:n]] = np.arange(n)
    parent = np.where(top, -1, where[number[n:]])
    # levels count from each shard's top; a child's level is its parent's and one
    level = np.where(top, 0, -1)
    order, begins, now = [], [], np.flatnonzero(top)
    rank = np.empty(n, dtype=np.int64)
    children = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[children], np.arange(n + 1))
    done = 0
    now = now[np.lexsort((names[now, 1], names[now, 0]))]
    while len(now):
        begins.append(done)
        rank[now] = np.arange(done, done + len(now))
        order.append(now)
        done += len(now)
        counts = first[now + 1] - first[now]
        starts = np.repeat(first[now] - np.r_[0, np.cumsum(counts)[:-1]], counts)
        below = children[starts + np.arange(counts.sum())]
        now = below[np.lexsort((names[below, 1], names[below, 0], rank[parent[below]]))]
    order = np.concatenate(order)
    assert len(order) == n, "a shard lacks a node between its top and another"
    return order, np.where(top[order], -1, rank[parent[order]]), np.array([*begins, n])


def rolled_up(bits: np.ndarray, begins: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each node's values summed over its subtree. values: a row for each measure, in level order."""
    parent, total = parents(bits), values.copy()
    for k in range(len(begins) - 2, 0, -1):
        level = slice(begins[k], begins[k + 1])
        for measure in total:
            np.add.at(measure, parent[level], measure[level])
    return total


def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Nodes of whole shards, sorted by shard, with what their subtrees sum up to."""
    turn_to("")

    def block(rows: pa.Table) -> pa.RecordBatch:
        column = {c: rows.column(c).to_numpy() for c in ("depth", "k1", "k2", "p1", "p2", "n_convs", "bytes", "conv_id")}
        top = rows.column("top").to_numpy(zero_copy_only=False)
        order, parent, begins = level_order(np.c_[column["k1"], column["k2"]], np.c_[column["p1"], column["p2"]], column["depth"], top)
        bits = louds(parent)
        labels = {c: v[order] for c, v in column.items()}
        n_children = degrees(bits)
        leaves, saved = rolled_up(bits, begins, np.stack(((n_children == 0).astype(np.int64), (labels["n_convs"] - 1) * labels["bytes"])))
        inside = parent >= 0
        of = pa.array(np.where(inside, labels["conv_id"][parent], 0), mask=~inside)
        arrays = [*[pa.array(labels[c]) for c in ("depth", "k1", "k2", "p1", "p2", "conv_id")], of, *[pa.array(x) for x in (labels["n_convs"], n_children, leaves, saved)]]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "k1", "k2", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", *MEASURES])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < SHARD:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        a, b = (rows.column(c).to_numpy() for c in ("s1", "s2"))
        whole = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if ((a != a[-1]) | (b != b[-1])).any() else 0
        if whole:
            yield block(rows.slice(0, whole))
        waiting = rows.slice(whole).to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        yield block(pa.Table.from_batches(waiting).combine_chunks())


LAID_OUT = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, pos from 1 on, l1, l2, bytes): each turn in order, by a 128-bit label of role and text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    label = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    half = [F.conv(F.substring(label, at, 16), 16, -10).cast("long").alias(c) for at, c in ((1, "l1"), (17, "l2"))]
    kept = in_order(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id", *half, F.octet_length("text").cast("long").alias("bytes")], scratch, "turns")
    return positions(kept, "conv_id").select("conv_id", "pos", "l1", "l2", "bytes")


def rebuilt(turns: DataFrame, lengths: DataFrame, fan: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: the first h turns of conversation c - c % fan, then c's own after its first
    h; h = crc32(c) % heads. Gives their turns (conv_id, depth, l1, l2, bytes) and lengths (conv_id, length)."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    of = lengths.select("conv_id", "length", h, (F.col("conv_id") - F.col("conv_id") % fan).alias("leader"))
    leaders = lengths.select(F.col("conv_id").alias("leader"), F.col("length").alias("there"))
    of = of.join(leaders, "leader", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    lent = turns.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "leader").join(of.select("leader", "conv_id", "taken"), "leader").filter("pos <= taken")
    own = turns.filter(F.col("pos") > h).join(of.select("conv_id", "h", "taken"), "conv_id")
    both = lent.select("conv_id", F.col("pos").cast("long").alias("depth"), "l1", "l2", "bytes").unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).cast("long").alias("depth"), "l1", "l2", "bytes"))
    return both, of.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).cast("long").alias("length"))


def named(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Turns (conv_id, depth, bytes, length) with the names of the node (k1, k2) and of its parent (p1, p2)."""
    own = [F.xxhash64(*salt, "depth", "l1", "l2").alias(c) for c, salt in (("z1", []), ("z2", [F.lit(1)]))]
    rows = turns.select("conv_id", "depth", "bytes", *own, F.shiftright("depth", STRETCH_BITS).alias("stretch"))
    by = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    rows = rows.select("conv_id", "depth", "bytes", "stretch", "z1", "z2", F.bit_xor("z1").over(by).alias("k1"), F.bit_xor("z2").over(by).alias("k2"))
    long = turns.filter(F.col("depth") >= 1 << STRETCH_BITS).select("conv_id").distinct()
    stretches = turns.join(long, "conv_id", "left_semi").select("conv_id", *own, F.shiftright("depth", STRETCH_BITS).alias("stretch"))
    stretches = stretches.groupBy("conv_id", "stretch").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("conv_id", "stretch", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"))
    rows = rows.join(stretches, ["conv_id", "stretch"], "left").join(lengths, "conv_id")
    for c in "12":
        rows = rows.withColumn(f"k{c}", F.col(f"k{c}").bitwiseXOR(F.coalesce(f"b{c}", F.lit(0))))
    return rows.select("conv_id", "depth", "bytes", "length", "k1", "k2", *[F.col(f"k{c}").bitwiseXOR(F.col(f"z{c}")).alias(f"p{c}") for c in "12"])


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """The SHA-256 of the ids that end at each node, ascending and comma-joined. ends: (conv_id, depth, k1, k2).

    Ids are dealt by ranges, joined in texts of CHUNK ids, and the texts of a node run through one hash."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.c_[tuple(batch.column(c).to_numpy() for c in NAME)]
            ids = batch.column("conv_id").to_numpy()
            cuts = np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1
            edges = np.r_[0, cuts, len(ids)]
            pieces = [(i, min(i + CHUNK, b)) for a, b in zip(edges[:-1], edges[1:]) for i in range(a, b, CHUNK)]
            first = [a for a, _ in pieces]
            arrays = [pa.array(name[first, k]) for k in range(3)] + [pa.array(ids[first]), pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in pieces], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*NAME, "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, sha = None, None
        schema = pa.schema([(c, pa.int64()) for c in NAME] + [("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")]):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, sha.hexdigest())))], schema)

    dealt = ends.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").select(*NAME, "conv_id")
    texts = scratch(dealt.mapInArrow(joined, "depth long, k1 long, k2 long, least long, ids string"), "chunks")
    return texts.repartition(*NAME).sortWithinPartitions(*NAME, "least").select(*NAME, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def same(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    return F.lit(True) if not left else (a[left[0]] == b[right[0]]) & same(a, b, left[1:], right[1:])


def merged_above(heavy: DataFrame, scratch: Scratch) -> DataFrame:
    """n_leaves and saved_tokens of heavy nodes (depth, k1, k2, p1, p2, …), summed over all heavy nodes below each.

    Round k knows sums over descendants less than 2^k levels down, and the ancestor 2^k levels up."""
    links = heavy.select(*NAME, "n_leaves", "saved_tokens", (F.col("depth") - 1).alias("a0"), F.col("p1").alias("a1"), F.col("p2").alias("a2")).withColumn("a0", F.expr("if(a0 < 0, null, a0)"))
    up, k, last = ["a0", "a1", "a2"], 0, None
    now = links
    while True:
        far = 1 << k
        if now.filter("a0 is not null").isEmpty():
            done = now.select(*NAME, "n_leaves", "saved_tokens")
            return done
        sums = now.filter("a0 is not null").groupBy(*up).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        ancestors = now.filter(f"depth >= {far}").select(F.col("depth").alias("u0"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("a0").alias("v0"), F.col("a1").alias("v1"), F.col("a2").alias("v2"))
        grown = now.join(sums.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(up)], "more_leaves", "more_saved"), F.expr("depth = s0 and k1 = s1 and k2 = s2"), "left")
        grown = grown.hint("merge").join(ancestors.hint("merge"), F.expr("a0 = u0 and a1 = u1 and a2 = u2"), "left")
        sum_of = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        now = scratch(grown.select(*NAME, *sum_of, F.col("v0").alias("a0"), F.col("v1").alias("a1"), F.col("v2").alias("a2")), f"heavy-{k}")
        if last:
            scratch.drop(last)
        last, k = f"heavy-{k}", k + 1


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch | None = None, shard: int = SHARD) -> DataFrame:
    """A row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    turns: (conv_id, depth from 1 on, l1, l2, bytes); lengths: (conv_id, length), a row for each conversation, those
    without turns too. Without conversations there are no nodes."""
    scratch = scratch or Scratch(turns.sparkSession)
    paths = scratch(named(turns, lengths), "paths")
    weight = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    nodes = paths.groupBy(*NAME).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"), weight)
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(c) for c in (*NAME, "p1", "p2")], "n_convs", "conv_id", zero.alias("bytes"), F.lit((1 << 62)).alias("weight"))
    nodes = scratch(nodes.unionByName(root), "nodes")

    # every node meets its parent, if that is heavy: the tops of shards, and heavy nodes, do
    heavy = nodes.filter(F.col("weight") > shard)
    over = heavy.select((F.col("depth") + 1).alias("h0"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.hint("merge").join(over.hint("merge"), F.expr("depth = h0 and p1 = h1 and p2 = h2"), "left").drop("h0", "h1", "h2")
    light = placed.filter(F.col("weight") <= shard)
    tops = light.filter("parent_conv_id is not null").select(F.col("depth").alias("t0"), F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    # a conversation goes through one top at most; the nodes of which it is the least member lie on its path
    homes = paths.select("conv_id", *NAME).hint("merge").join(tops.hint("merge"), F.expr("depth = t0 and k1 = t1 and k2 = t2")).select(F.col("conv_id").alias("home"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    sharded = light.hint("merge").join(homes.hint("merge"), F.expr("conv_id = home")).select(*NAME, "p1", "p2", "n_convs", "conv_id", "bytes", "s1", "s2", F.col("parent_conv_id").isNotNull().alias("top"))
    below = scratch(sharded.repartition("s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(laid_out, LAID_OUT), "shards")

    # the heavy upper levels: what hangs on each of them, then sums over those below
    under = below.filter("parent_conv_id is null").groupBy((F.col("depth") - 1).alias("u0"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    under = under.agg(F.count("*").alias("light_children"), F.sum("n_leaves").alias("light_leaves"), F.sum("saved_tokens").alias("light_saved"))
    upper = placed.filter(F.col("weight") > shard)
    kids = upper.filter("depth > 0").groupBy((F.col("depth") - 1).alias("w0"), F.col("p1").alias("w1"), F.col("p2").alias("w2")).agg(F.count("*").alias("heavy_children"))
    upper = upper.join(under, F.expr("depth = u0 and k1 = u1 and k2 = u2"), "left").join(kids, F.expr("depth = w0 and k1 = w1 and k2 = w2"), "left")
    n_children = F.coalesce("light_children", F.lit(0)) + F.coalesce("heavy_children", F.lit(0))
    leaves = F.coalesce("light_leaves", F.lit(0)) + F.when(n_children == 0, 1).otherwise(0)
    saved = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("light_saved", F.lit(0))
    upper = scratch(upper.select(*NAME, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens")), "upper")
    summed = merged_above(upper, scratch)
    upper = upper.drop("n_leaves", "saved_tokens").join(summed, NAME)

    # a top's parent is heavy; its id comes with the join above
    known = placed.filter(F.col("weight") <= shard).filter("parent_conv_id is not null").select(*NAME, F.col("parent_conv_id").alias("above"))
    below = below.join(known, NAME, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
    ends = paths.filter("depth = length").select("conv_id", *NAME).unionByName(lengths.filter("length = 0").select("conv_id", *[zero.alias(c) for c in NAME]))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", *MEASURES]
    every = below.select("k1", "k2", *columns).unionByName(upper.select("k1", "k2", *columns))
    out = every.join(end_digests(ends, scratch), NAME, "left")
    return out.select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, scratch: Scratch | None = None, shard: int = SHARD) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text) as `rebuilt` makes them.

    Turns go by turn (null first), equal turns by role and text; null roles and texts are empty; rows without a
    conv_id belong to no conversation and are left out; repeated rows are turns like others; other columns
    are not read; texts of any length count whole."""
    scratch = scratch or Scratch(conversations.sparkSession)
    turns = scratch(turns_of(conversations, scratch), "positions")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    made, lengths = rebuilt(turns, lengths)
    return trie(made, scratch(lengths, "lengths"), scratch, shard)
