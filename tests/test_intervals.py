"""Interval joins and the fold of conflicts against plain loops, and on one document with very many spans."""

import random
import time

from pyspark.sql import functions as F

from tessellum.operators import extraction
from tessellum.operators.intervals import containing_point, overlapping

SPANS = "doc_id long, a long, b long, n int"


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(1)

    def some(n):
        rows = []
        for i in range(n):
            a = rng.choice([0, 63, 64, 4095, 4096, rng.randrange(300_000), rng.randrange(1 << 26)])
            rows.append((rng.choice([1, 1, 2, None]), a, a + rng.choice([0, 1, 2, 64, 65, 4096, 5000, 300_000, 1 << 25]), i))
        return rows + [(1, None, 5, -1), (1, 5, None, -2), rows[0]]

    left, right = some(120), some(120)
    df = spark.createDataFrame(right, SPANS).withColumnsRenamed({"a": "c", "b": "d", "n": "m"})
    got = sorted((r["n"], r["m"]) for r in overlapping(spark.createDataFrame(left, SPANS), df, ["doc_id"], ("a", "b"), ("c", "d")).collect())
    want = sorted((n, m) for x, a, b, n in left for y, c, d, m in right if x is not None and x == y and None not in (a, b, c, d) and a < d and b > c)
    assert got == want


def test_points(spark):
    points = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (2, 3), (None, 1)], "doc_id long, at int")
    rows = spark.createDataFrame([(1, 0, 10, "x"), (1, 5, 5, "none"), (2, 3, 4, "y"), (1, 10, 5000, "z")], "doc_id long, start long, end long, name string")
    assert sorted((r["doc_id"], r["at"], r["name"]) for r in containing_point(points, rows, ["doc_id"]).collect()) == [(1, 0, "x"), (1, 9, "x"), (1, 10, "z"), (2, 3, "y")]
    assert containing_point(points.limit(0), rows, ["doc_id"]).collect() == []


def test_no_plan_compares_a_document_with_itself(spark):
    spans = spark.range(10).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit("t").alias("elem_id"), F.lit(1).alias("page"))
    plan = extraction.align(spans.drop("page", "elem_id"), spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "Cross" not in plan


def test_hot_document(spark):
    """1,000,000 mentions and 200,000 blocks of one document: aligned, kept apart and resolved."""
    n = 1_000_000
    mentions = spark.range(0, n, 1, 8).select(F.lit(7).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + F.when(F.col("id") % 4 == 0, 12).otherwise(5)).cast("int").alias("end"), (F.col("id") % 3).cast("int").alias("priority"), F.lit("t").alias("text"), F.lit("c").alias("canonical"), F.lit("k").alias("type"))
    blocks = spark.range(0, n // 5, 1, 8).select(F.lit(7).alias("doc_id"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 50).alias("end"), F.col("id").alias("elem_id"), F.lit(1).alias("page"))
    began = time.time()
    aligned = extraction.align(mentions, blocks).agg(F.count("*"), F.sum((F.col("block_id") == F.floor(F.col("start") / 50)).cast("int"))).first()
    assert tuple(aligned) == (n, n)
    # span 4k takes in 4k + 1, whose priority decides between them; the others stand alone
    kept = extraction.resolve(mentions).agg(F.count("*"), F.max("pos"), F.sum("priority"), F.sum("start")).first()
    best = [4 * k + ((4 * k + 1) % 3 < (4 * k) % 3) for k in range(n // 4)] + [4 * k + j for k in range(n // 4) for j in (2, 3)]
    assert tuple(kept) == (len(best), len(best) - 1, sum(i % 3 for i in best), sum(10 * i for i in best))
    assert time.time() - began < 240


def test_resolve_across_batches(spark):
    """Groups that go over the edges of Arrow batches, by a plain loop."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), a := rng.randrange(3000), a + rng.randrange(1, 90), rng.choice([1, 2, 3, None]), str(i), "c", "t") for i in range(700)]
    want = []
    for doc in (None, 1, 2):
        mine, pos, limit, best = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0, r[4])), -1, -1, None
        for r in mine:
            if best is not None and r[1] < limit:
                if r[3] is not None and best[3] is not None and r[3] < best[3]:
                    best = r
                continue
            if best is not None:
                want.append((doc, pos, *best[1:]))
            pos, limit, best = pos + 1, r[2], r
        want.append((doc, pos, *best[1:]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, start int, end int, priority int, text string, canonical string, type string")
        assert sorted((tuple(r) for r in extraction.resolve(df).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
