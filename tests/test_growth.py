"""What operators hold and write grows no faster than their input."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessellum.operators import extraction as E
from tessellum.operators import graph as G
from tessellum.operators import paths as P


@pytest.fixture
def sizes(monkeypatch):
    """Rows that each step of a walk writes, by its name."""
    seen = defaultdict(int)

    def counted(write):
        def run(df, name):
            out = write(df, name)
            seen[name] += out.count()
            return out

        return run

    for module in (G, P):
        monkeypatch.setattr(module, "written", counted(module.written))
    return seen


def graph(seed):
    rng = random.Random(seed)
    edges = [(f"h{rng.randrange(6)}", "E", f"h{rng.randrange(6)}") for _ in range(6)] + [(f"l{i}", "E", f"h{rng.randrange(6)}") for i in range(30)]
    return [*edges, ("x", "E", "y"), ("l0", "F", edges[6][2]), ("z", "E", "z")]


def hops(edges, start, depth):
    near = defaultdict(set)
    for a, _, b in edges:
        near[a].add(b), near[b].add(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in near[a] if seen[a] < depth else ():
            if b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    return {(start, b, n) for b, n in seen.items() if n}


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_with_leaves(spark, seed):
    edges = graph(seed)
    starts = ["h0", "h1", "l0", "l1", "l2", "x", "y", "z", "nowhere"]
    found = G.distances(spark.createDataFrame(edges, "src string, rel_type string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), 3)
    assert sorted(map(tuple, found.collect())) == sorted(x for s in starts for x in hops(edges, s, 3))


def star(spark, n):
    """Two hubs with n leaves each."""
    at = spark.range(2 * n)
    leaf = at.select(F.concat(F.lit("l"), "id").alias("src"), F.lit("E").alias("rel_type"), F.concat(F.lit("h"), F.col("id") % 2).alias("dst"))
    return leaf.union(spark.createDataFrame([("h0", "E", "h1")], "src string, rel_type string, dst string"))


def test_walks_leave_leaves_out(spark, sizes):
    edges = star(spark, 300)
    starts = spark.range(100).select(F.concat(F.lit("l"), "id").alias("start"))
    found = G.distances(edges, starts)
    assert found.count() == 100 * 601 and sizes["hop"] < 20
    few = G.distances(edges, starts, ends=spark.createDataFrame([("l7",), ("h1",)], "end string"))
    assert few.count() == 199
    pairs = starts.withColumn("end", F.concat(F.lit("l"), F.substring("start", 2, 9).cast("int") + 101))
    rows = P.shortest_path_rows(edges, pairs)
    assert {tuple(r) for r in rows.select("hops").distinct().collect()} == {(3,)} and rows.count() == 100
    assert sizes["frontier"] < 2000


def test_scans_send_on_what_they_find():
    frames = list(E._sent(((i,) for i in range(2 * E.HELD + 5)), ["n"]))
    assert [len(f) for f in frames] == [E.HELD, E.HELD, 5]


def test_contexts_of_a_scan(spark):
    texts = spark.createDataFrame([(1, "the  end é\U0001f600 of the" + " x" * 40), (2, "the"), (3, None)], "doc_id long, text string")
    found = E.scan(texts, [("the", "the", "A", 1)], 5).join(texts.withColumnRenamed("text", "body"), "doc_id")
    rows = found.select("context", E.context(F.col("body"), F.col("start"), F.col("end"), 5)).collect()
    assert len(rows) == 3 and all(a == b for a, b in rows)


def spans_of(spark, kinds):
    rows = [(1, 2 * i, 2 * i + 1, i, k.lower(), k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id long, start int, end int, pos int, text string, type string").withColumn("confidence", F.lit(0.8))


def test_pairs_of_a_window_are_counted_not_listed(spark):
    """a window of n mentions gives a row for equal texts, and the text of its evidences is no one string."""
    rng = random.Random(4)
    kinds = [rng.choice("HTX") for _ in range(600)]
    sents = spark.createDataFrame([(1, 0, "first  half", 0, 600), (1, 1, "second", 600, 1000), (1, 2, "third", 1000, 1200)], "doc_id long, sent_no int, sentence string, start long, end long")
    pairs = [("H", "T", "r"), ("T", "T", "same")]
    relations = E.window_relations(spans_of(spark, kinds), sents, pairs)
    got = {(r["at"]["sent_no"], r["relation"]): (r["times"], r["at"]["a"], r["at"]["b"]) for r in relations.collect()}
    want = {}
    for window, (a, z) in enumerate([(0, 500), (300, 600)]):
        for head, tail, name in pairs:
            found = [(h, t) for h in range(a, z) for t in range(h + 1, z) if (kinds[h], kinds[t]) == (head, tail)]
            want[window, name] = (len(found), *min(found))
    assert got == want and relations.count() == 4
    texts = E.aggregate_evidence(relations).withColumn("evidence_md5", F.md5("evidence"))
    columns = ["doc_id", "head", "head_type", "relation", "tail", "tail_type", "confidence", "evidence_count", "method", "evidence_md5"]
    assert sorted(map(tuple, E.evidence_digests(relations).select(columns).collect())) == sorted(map(tuple, texts.select(columns).collect()))


def test_spans_attach_to_what_they_start_in(spark, monkeypatch):
    """in one pass over sorted starts, without a join."""
    monkeypatch.setattr(E, "BIN", 1)
    rows = spark.createDataFrame([(1, i, i) for i in range(12)] + [(2, 3, 0), (None, 3, 0), (1, None, 99)], "doc_id long, start int, n int")
    spans = spark.createDataFrame([(1, 0, 2, "a"), (1, 2, 2, "empty"), (1, 2, 5, "b"), (1, 7, 9, "c"), (None, 0, 9, "z"), (3, 0, 9, "y")], "doc_id long, start long, end long, elem_id string").withColumn("page", F.lit(1))
    found = E.align(rows, spans)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {(1, i): "a" if i < 2 else "b" if i < 5 else "c" if 7 <= i < 9 else None for i in range(12)} | {(2, 0): None, (None, 0): None, (1, 99): None}
    assert {(r["doc_id"], r["n"]): r["block_id"] for r in found.collect()} == want
    two = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 2, 6), (1, 2, 4, 8)], "doc_id long, window int, start long, end long")
    assert sorted((r["start"], r["window"]) for r in E.in_spans(rows.filter("doc_id = 1"), two, "window", 2).collect()) == [(i, w) for i in range(8) for w in range(3) if 2 * w <= i < 2 * w + 4]
