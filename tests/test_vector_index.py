"""The stored vector index against exact search: recall, what it reads, inserts and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from tessellum.operators import retrieval, vector_index
from tessellum.sources.fixtures import table
from tessellum.sources.scratch import fresh_path

SF = "/root/testdata/sf0.1"


def test_recall_and_rows_read(spark):
    """At sf0.1: at least 0.9 of the exact ten nearest, with less than a quarter of the vectors read whole."""
    vectors = table(spark, SF, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    queries = table(spark, SF, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vector_index.build(vectors, fresh_path(spark, "vectors"), nlist=64)
    n, n_queries = vectors.count(), queries.count()
    assert index.lists().select(F.explode("ids")).distinct().count() == n == index.vectors().count()
    exact = {(r["query_id"], r["id"]) for r in retrieval.vector_top(queries, vectors, 10).collect()}
    again = vector_index.opened(spark, index.path)
    got = vector_index.search(again, queries, 10, nprobe=40, refine=120).collect()
    assert len({(r["query_id"], r["id"]) for r in got} & exact) >= 0.9 * len(exact)
    assert vector_index.candidates(again, queries, 40, 120).count() <= 120 * n_queries < n * n_queries / 4
    fewer = vector_index.search(again, queries, 10, nprobe=4, refine=200).collect()
    assert len({(r["query_id"], r["id"]) for r in fewer} & exact) < len(exact)
    whole = {(r["query_id"], r["id"]): r["score"] for r in vector_index.search(again, queries, 10, nprobe=64, refine=2000).collect()}
    want = {(r["query_id"], r["id"]): r["score"] for r in retrieval.vector_top(queries, vectors, 10).collect()}
    assert whole.keys() == want.keys() and all(abs(whole[k] - want[k]) < 1e-5 for k in want)


def test_clusters_inserts_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SEGMENT", 16)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10)) * 5
    made = [(f"v{i}", [float(v) for v in centres[i % 12] + rng.normal(size=10)]) for i in range(400)]
    odd = [("zero", [0.0] * 10), ("short", [1.0, 2.0]), ("none", None), ("empty", []), ("nan", [float("nan")] * 10), ("hole", [None] + [1.0] * 9), ("twice", made[0][1]), ("twice", made[0][1])]
    schema = "id string, vector array<double>"
    index = vector_index.build(spark.createDataFrame(made[:300] + odd, schema), fresh_path(spark, "vectors"), nlist=12, parts=4)
    files = set(index.lists().inputFiles())
    vector_index.insert(index, spark.createDataFrame(made[300:], schema))
    assert files < set(index.lists().inputFiles()) and index.vectors().count() == 402
    queries = spark.createDataFrame([(i, made[i][1]) for i in range(0, 400, 20)] + [(1000, None), (1001, [1.0])], "query_id long, query_vector array<double>")
    everything = spark.createDataFrame(made + odd[-2:], schema)
    exact = {(r["query_id"], r["id"]) for r in retrieval.vector_top(queries.filter("query_id < 1000"), everything, 5).collect()}
    got = vector_index.search(index, queries, 5, nprobe=3, refine=60).collect()
    assert {r["query_id"] for r in got} == set(range(0, 400, 20)) and len({(r["query_id"], r["id"]) for r in got} & exact) >= 0.95 * len(exact)
