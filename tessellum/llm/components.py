"""Connected components of a graph in a table: union-find within each partition, then alternating large and small stars.

Every half round writes its edges to the shared folder, so a lost executor costs one step at most, and
nothing but two totals comes to the driver. Each node ends up linked to the least node it can reach.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, turn_to

#: Edges that are contracted at once.
BLOCK = 1 << 18


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over some edges: each node that isn't the least of its set, and that least one."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(names))
    x, y = ends[: len(a)], ends[len(a) :]
    while len(x):  # hook the greater root to the lesser one, then halve the paths until they are flat
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges (a, b), a > b: a block's edges become links to its least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        turn_to("")
        left, right, n = [], [], 0

        def flushed() -> pa.RecordBatch:
            a, b = contracted(np.concatenate(left), np.concatenate(right))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            left.append(batch.column(0).to_numpy())
            right.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= BLOCK:
                yield flushed()
                left, right, n = [], [], 0
        if n:
            yield flushed()

    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, scratch: Scratch, table: str = "roots", a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge of long ends, as the named table; loops and null ends count for nothing."""
    name = "edges-0"
    now = scratch(contract(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b")).distinct(), name)
    before, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            roots = scratch(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct(), table)
            scratch.drop(name)
            return roots
        before, k = mark, k + 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = scratch(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), f"stars-{k}")
        scratch.drop(name)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        name = f"edges-{k}"
        now = scratch(small.union(least).filter("a <> b").distinct(), name)
        scratch.drop(f"stars-{k}")
