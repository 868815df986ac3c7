"""Paths and patterns on random graphs against breadth-first search and nested loops."""

import random
from itertools import product

from pyspark.sql import functions as F

from tessellum.operators.paths import Edge, Node, match, shortest_path_rows

EDGES = "src string, rel_type string, dst string"


def graph(seed, n=40, m=60):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", rng.choice("AB"), f"n{rng.randrange(n)}") for _ in range(m)] + [("hub", "C", f"n{i}") for i in range(0, n, 9)]


def least_path(edges, start, end, depth):
    """All walks, level by level, least first."""
    ways = {}
    for s, r, d in edges:
        if s != d:
            for a, b, via in ((s, d, ">" + r), (d, s, "<" + r)):
                ways.setdefault(a, {})[b] = min(via, ways.get(a, {}).get(b, "~"))
    level = {start: ((start,), ())}
    seen = {start}
    for _ in range(depth):
        after = {}
        for node, (nodes, vias) in level.items():
            for b, via in ways.get(node, {}).items():
                new = ((*nodes, b), (*vias, via))
                if b not in seen and (b not in after or new < after[b]):
                    after[b] = new
        if end in after:
            return after[end]
        seen |= set(after)
        level = after
    return None


def test_least_shortest_paths(spark):
    edges = graph(3)
    pairs = [(f"n{i}", f"n{j}") for i in range(0, 40, 7) for j in range(0, 40, 3)] + [("n0", "gone"), (None, "n1"), ("n0", "n3"), ("n0", "n3")]
    got = {(r["start"], r["end"]): (tuple(r["nodes"]), tuple(r["vias"]), r["hops"]) for r in shortest_path_rows(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "start string, end string"), 4).collect()}
    want = {(a, b): (*p, len(p[1])) for a, b in set(pairs) if a and a != b and (p := least_path(edges, a, b, 4))}
    assert got == want and len(want) > 20


def test_patterns(spark):
    edges = list(dict.fromkeys(graph(5, 12, 25)))
    nodes = [(n, [f"L{i % 2}"], i) for i, n in enumerate(sorted({x for s, _, d in edges for x in (s, d)}))]
    label, size = {n: ls[0] for n, ls, _ in nodes}, {n: s for n, _, s in nodes}
    vs, es = spark.createDataFrame(nodes, "id string, labels array<string>, size int"), spark.createDataFrame(edges, EDGES)
    got = sorted(tuple(r) for r in match(vs, es, Node("a", "L0"), Edge(["A", "B"]), Node("b"), Edge(direction="any"), Node("c", where=F.col("size") > 3)).collect())
    want = []
    for e, f in product(edges, edges):
        for x, y in {(f[0], f[2]), (f[2], f[0])}:
            if e != f and e[1] in "AB" and label[e[0]] == "L0" and e[2] == x and size[y] > 3:
                want.append((e[0], e[2], y, e[1], f[1]))
    assert got == sorted(want) and want
    assert match(vs, es, Node("a", "L1", {"size": 1})).count() == 1
    assert match(vs, es.limit(0), Node("a"), Edge(direction="in"), Node("b")).collect() == []
