"""Shortest paths with their nodes and edges, and patterns of edges, as joins.

Paths grow from both ends: a frontier holds, for each node that a start reaches in so many edges, the
least path to it, by its nodes and then its edges. A shortest path of n edges has a node after half of
them, and its halves are least paths to that node, so the least of all joined halves is the least path.
Nodes of one neighbour are on no path but as its ends, so frontiers don't grow into them after the first edge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.operators.graph import MOST_DEPTH, find_nodes
from tessellum.sources.scratch import written


def steps(edges: DataFrame) -> DataFrame:
    """Edges in both directions (src, dst, via): the least type between two nodes, `>` or `<` by its direction."""
    there = edges.select("src", "dst", F.concat(F.lit(">"), "rel_type").alias("via"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("<"), "rel_type").alias("via"))
    return there.union(back).filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("via").alias("via"))


def _grown(last: DataFrame, before: DataFrame | None, rows: DataFrame, forward: bool) -> DataFrame:
    """The next frontier (start, node, path): paths of struct<nodes, vias> one edge longer, to nodes that are met first."""
    path = lambda c, x: F.concat(c, F.array(x)) if forward else F.concat(F.array(x), c)
    near, far = ("src", "dst") if forward else ("dst", "src")
    longer = F.struct(path(F.col("path.nodes"), F.col(far)).alias("nodes"), path(F.col("path.vias"), F.col("via")).alias("vias")).alias("path")
    found = last.join(rows, F.col("node") == F.col(near)).select("start", F.col(far).alias("node"), longer)
    found = found.groupBy("start", "node").agg(F.min("path").alias("path"))
    for seen in (last, before):
        if seen is not None:
            found = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
    return found


def shortest_path_rows(edges: DataFrame, pairs: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """Rows (start, end, hops, nodes, vias): the shortest path of each pair (start, end) that has one of at most `depth` edges,
    over edges of either direction; of several the one with the least nodes, then the least edges.

    vias are types of edges, with `>` along them and `<` against. Pairs of one node with itself, of unknown
    nodes and with nulls have no path; repeated pairs count once. A pair leaves the walk when its path is
    known, and frontiers are those of the pairs that are left."""
    rows = written(steps(edges), "steps")
    within = written(rows.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("src").alias("inner")), "inner")
    left = written(pairs.select("start", "end").filter("start <> end").distinct(), "pairs")
    empty = F.struct(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("vias")).alias("path")
    sides = {c: [written(left.select(F.col(c).alias("start"), F.col(c).alias("node")).distinct().select("start", "node", empty), "frontier")] for c in ("start", "end")}
    done = []
    for hops in range(1, depth + 1):
        side = "start" if hops % 2 else "end"
        frontiers = sides[side]
        alive = frontiers[-1].join(left.select(F.col(side).alias("start")).distinct(), "start", "left_semi")
        onward = rows if hops == 1 else rows.join(within, F.col("dst" if side == "start" else "src") == F.col("inner"), "left_semi")
        frontiers.append(written(_grown(alive, frontiers[-2] if len(frontiers) > 1 else None, onward, side == "start"), "frontier"))
        a = sides["start"][-1].select("start", "node", F.col("path").alias("head"))
        b = sides["end"][-1].select(F.col("start").alias("end"), "node", F.col("path").alias("tail"))
        joined = F.struct(F.concat("head.nodes", F.expr("slice(tail.nodes, 2, size(tail.nodes))")).alias("nodes"), F.concat("head.vias", "tail.vias").alias("vias"))
        met = left.join(a, "start").join(b, ["end", "node"]).groupBy("start", "end").agg(F.min(joined).alias("path"))
        done.append(written(met.select("start", "end", F.lit(hops).alias("hops"), "path.nodes", "path.vias"), "paths"))
        if hops < depth:
            left = written(left.join(done[-1].select("start", "end"), ["start", "end"], "left_anti"), "pairs")
            if left.isEmpty() or frontiers[-1].isEmpty():
                break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class Node:
    """What a node of a pattern has to be: a label, values of properties, and any further condition on its columns."""

    name: str
    label: str | None = None
    properties: dict = field(default_factory=dict)
    where: Column | None = None


@dataclass
class Edge:
    """An edge between two nodes of a pattern: its types, and `out`, `in` or `any` from the left node's side."""

    types: Sequence[str] = ()
    direction: str = "out"


def match(nodes: DataFrame, edges: DataFrame, *pattern: Node | Edge) -> DataFrame:
    """Every way to lay a pattern Node, Edge, Node, Edge, Node … over the graph: a column of ids for each node, by its name,
    and `rel_1`, `rel_2`, … for the types of edges.

    No edge is used twice in one match, but a node may be. Conditions on nodes become semi-joins on ids before
    edges meet, so only edges between fitting nodes are joined, one join for each edge; Spark chooses which side
    to build. A pattern of one node is those nodes."""
    asked = pattern[::2]
    fitting = []
    for n in asked:
        found = find_nodes(nodes, n.label, **n.properties)
        fitting.append((found if n.where is None else found.filter(n.where)).select(F.col("id").alias(n.name)))
    out = fitting[0]
    free = [not (n.label or n.properties or n.where is not None) for n in asked]
    for i, edge in enumerate(pattern[1::2], 1):
        left, right = asked[i - 1].name, asked[i].name
        kind = edges if not edge.types else edges.filter(F.col("rel_type").isin(*edge.types))
        there = kind.select(F.col("src").alias(left), F.col("dst").alias(right), F.col("rel_type").alias(f"rel_{i}"), F.struct("src", "rel_type", "dst").alias(f"__e{i}"))
        back = kind.select(F.col("dst").alias(left), F.col("src").alias(right), F.col("rel_type").alias(f"rel_{i}"), F.struct("src", "rel_type", "dst").alias(f"__e{i}"))
        rows = {"out": there, "in": back, "any": there.unionByName(back.filter(F.col(left) != F.col(right)))}[edge.direction]
        if not free[i]:
            rows = rows.join(fitting[i], right, "left_semi")
        out = out.join(rows, left)
        for k in range(1, i):
            out = out.filter(F.col(f"__e{k}") != F.col(f"__e{i}"))
    return out.select(*[n.name for n in asked], *[f"rel_{i}" for i in range(1, len(asked))])
