"""Ingestion by stages: states, what each stage leaves, lost attempts and documents that come again."""

import pytest
from pyspark.sql import functions as F

from tessellum.operators import retrieval as Q
from tessellum.streaming import ingestion as I

TERMS = [("cho", "CHO", "CellLine", 1), ("hcp", "HCP", "Protein", 2), ("kit", "kit", "Product", 4)]
SCHEMA = "doc_id long, text string"
FIRST = [(1, "Cells\nCHO produces HCP in this long line of plain text here. The kit detects HCP too."), (2, " \n "), (3, None), (4, "Kits\nA kit that measures the HCP of cells, a line that is no title.\na | b"), (4, "A"), (None, "x")]
SECOND = [(1, "Vero\nNothing but a line of words that has no protein of any sort in it."), (5, "Host\nHCP here and HCP there, and CHO in the end of all the lines.")]
EDGE = ["src", "rel_type", "dst"]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def all_of(store):
    """What counts in a store, whatever way it has come."""
    spark = store.spark
    found = {f"{stage}.{name}": rows(store.table(name, stage)) for stage, names in {"structure": ["blocks"], "vectors": ["vectors"], "search": ["search_documents"], "graph": ["mentions", "nodes", "edges", "extractions"], "tables": ["sections", "tables", "table_lines"]}.items() for name in names}
    nodes, edges = I.graph_of(store)
    queries = spark.createDataFrame([(1, "HCP line"), (2, "protein words"), (3, "kit")], "query_id int, query string")
    hits = Q.bm25(queries, Q.opened(spark, f"{store.root}/search_index")).select("query_id", "_id", F.round("score", 9).alias("score"))
    near = I.search_vectors(store, queries.select("query_id", Q.encoder()(F.col("query")).alias("query_vector")), 5, nprobe=4).select("query_id", "key", F.round("score", 6).alias("score"))
    return found | {"states": rows(store.states()), "graph": rows(nodes) + rows(edges.select(EDGE)), "hits": rows(hits), "near": rows(near)}


def made(spark, root, spoil=None):
    """A store; spoil: the stage and the step in which the first attempt breaks off."""
    stages = I.file_stages(TERMS, nlist=2, parts=4)
    for s in stages:
        if spoil and s.name == spoil[0]:
            whole, left = getattr(s, spoil[1]), [1]

            def broken(b, whole=whole, left=left):
                out = whole(b)
                if left:
                    left.pop()
                    raise RuntimeError("lost")
                return out

            setattr(s, spoil[1], broken)
    return I.Ingested(spark, str(root), stages)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    store = made(spark, tmp_path_factory.mktemp("plain"))
    for n, docs in enumerate([FIRST, SECOND]):
        store.ingest(spark.createDataFrame(docs, SCHEMA), n)
    return store, all_of(store)


def test_states_and_tables(spark, plain):
    store, found = plain
    assert sorted(map(tuple, store.states().collect())) == [(1, 1, "completed"), (2, 0, "extract_failed"), (3, 0, "extract_failed"), (4, 0, "completed"), (5, 1, "completed")]
    assert {r["doc_id"] for r in store.table("blocks", "structure").collect()} == {1, 4, 5}
    assert {r["title"] for r in store.table("sections", "tables").collect()} == {"Vero", "Kits", "Host", "文档内容"} - ({"文档内容"} if not any("文档内容" in r for r in found["tables.sections"]) else set())
    assert store.table("nodes", "graph").filter("doc_id = 1 and text = 'HCP'").isEmpty()
    assert not store.table("nodes", "graph").filter("doc_id = 5 and lower(text) = 'hcp'").isEmpty()
    assert store.table("table_lines", "tables").count() == 1


def test_search_counts_as_a_fresh_index(spark, plain, tmp_path):
    store, found = plain
    queries = spark.createDataFrame([(1, "HCP line"), (2, "protein words"), (3, "kit")], "query_id int, query string")
    fresh = Q.bm25(queries, Q.add_documents(store.table("search_documents", "search").drop("batch"), f"{tmp_path}/fresh"))
    assert rows(fresh.select("query_id", "_id", F.round("score", 9).alias("score"))) == found["hits"] and found["hits"]
    assert found["near"] and all("key='0:1_" not in r for r in found["near"])


@pytest.mark.parametrize("spoil", [("vectors", "finish"), ("search", "finish")])
def test_a_lost_attempt_changes_nothing(spark, plain, tmp_path, spoil):
    store = made(spark, tmp_path / "store", spoil)
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: I.start(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination(120)
    k = [s.name for s in store.stages].index(spoil[0])
    assert [store.committed(i, 0) for i in range(5)] == [i < k for i in range(5)]
    assert stream().awaitTermination(120)
    spark.createDataFrame(SECOND, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert stream().awaitTermination(120)
    if spoil[0] == "search":
        store.ingest(spark.createDataFrame(SECOND, SCHEMA), 1)  # a batch that comes again
    assert all_of(store) == plain[1]


def test_a_failed_document_goes_no_further(spark, tmp_path):
    stages = [I.Stage("a", "a_done", "a_failed", lambda b: {"t": b.docs}, lambda b: b.docs.filter("text <> 'x'")), I.Stage("b", "b_done", "b_failed", lambda b: {"u": b.docs}, lambda b: b.docs.filter("text <> 'y'"))]
    store = I.Ingested(spark, str(tmp_path), stages)
    assert store.states().count() == 0
    store.ingest(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], SCHEMA), 0)
    assert sorted(map(tuple, store.states().collect())) == [(1, 0, "a_failed"), (2, 0, "b_failed"), (3, 0, "b_done")]
    assert [r["doc_id"] for r in store.table("u", "b").collect()] == [3]
    store.ingest(spark.createDataFrame([], SCHEMA), 1)
    store.ingest(spark.createDataFrame([(3, "x")], SCHEMA), 2)
    assert sorted(map(tuple, store.states().collect())) == [(1, 0, "a_failed"), (2, 0, "b_failed"), (3, 2, "a_failed")]
