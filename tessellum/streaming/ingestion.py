"""Ingestion by stages: structure, vectors, search index, graph, rows of tables.

A batch of documents goes through the stages in order; a document that fails in one is looked at by none
after it. A stage writes its tables for the batch, then its part of the ledger, and that commits it: a batch
that comes again goes on after the last committed stage, and what a lost attempt has left is written over.
All tables are appended by batch, so no batch writes another's rows; of a document that comes again the
rows of its last batch count."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import extraction as E
from tessellum.operators import retrieval as Q
from tessellum.operators import structure as S
from tessellum.operators import vector_index as V
from tessellum.operators.graph import contains_edges, upsert_edges, upsert_nodes
from tessellum.sources.fixtures import text_elements
from tessellum.sources.scratch import exists

LEDGER = "doc_id long, ok boolean, batch long"


@dataclass
class Stage:
    """A step of ingestion. run: gives the tables (each with doc_id) of a batch's documents, and after they are
    written `passed` says which documents (doc_id) go on; without it all do. finish: what else the stage keeps,
    under the batch's name, so that doing it again changes nothing."""

    name: str
    done: str
    failed: str
    run: Callable[[Batch], dict[str, DataFrame]]
    passed: Callable[[Batch], DataFrame] | None = None
    finish: Callable[[Batch], None] | None = None


@dataclass
class Batch:
    """A batch in a stage: its number, the documents that have come so far, and what earlier stages wrote for them."""

    store: Ingested
    number: int
    docs: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/tables/{name}/batch={self.number}").join(self.docs.select("doc_id"), "doc_id", "left_semi")


@dataclass
class Ingested:
    """What ingestion keeps under a folder that driver and executors share."""

    spark: SparkSession
    root: str
    stages: Sequence[Stage]

    def _ledger(self, k: int, number: int) -> str:
        return f"{self.root}/ledger/{self.stages[k].name}/batch={number}"

    def committed(self, k: int, number: int) -> bool:
        return exists(self.spark, f"{self._ledger(k, number)}/_SUCCESS")

    def ingest(self, docs: DataFrame, number: int) -> None:
        """Take a batch (doc_id, text, …) through what it hasn't been through. Rows without a doc_id are left out; of rows of one id the one of the greatest text counts, a null one least."""
        once = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), F.struct("text")).alias("d")).select("doc_id", "d.*")
        for k, stage in enumerate(self.stages):
            if self.committed(k, number):
                continue
            given = once if k == 0 else once.join(self.spark.read.schema("doc_id long, ok boolean").parquet(self._ledger(k - 1, number)).filter("ok").select("doc_id"), "doc_id", "left_semi")
            batch = Batch(self, number, given)
            for name, rows in stage.run(batch).items():
                rows.write.mode("overwrite").parquet(f"{self.root}/tables/{name}/batch={number}")
            if stage.finish:
                stage.finish(batch)
            ok = F.lit(True)
            rows = given.select("doc_id")
            if stage.passed:
                rows = rows.join(stage.passed(batch).select("doc_id", F.lit(True).alias("ok")).distinct(), "doc_id", "left")
                ok = F.coalesce("ok", F.lit(False))
            rows.select(F.col("doc_id").cast("long").alias("doc_id"), ok.alias("ok")).write.mode("overwrite").parquet(self._ledger(k, number))

    def ledger(self, stage: str) -> DataFrame:
        """Each document's last committed batch in a stage: (doc_id, batch, ok)."""
        k = [s.name for s in self.stages].index(stage)
        where = f"{self.root}/ledger/{stage}"
        numbers = [n for n in batches(self.spark, where) if self.committed(k, n)]
        rows = self.spark.read.schema(LEDGER).option("basePath", where).parquet(*[self._ledger(k, n) for n in numbers]) if numbers else self.spark.createDataFrame([], LEDGER)
        return rows.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("ok", "batch").alias("ok"))

    def table(self, name: str, stage: str) -> DataFrame:
        """The rows of a stage's table that count, with their batch."""
        rows = self.spark.read.option("basePath", f"{self.root}/tables/{name}").parquet(f"{self.root}/tables/{name}").withColumn("batch", F.col("batch").cast("long"))
        return rows.join(self.ledger(stage).filter("ok").select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")

    def states(self) -> DataFrame:
        """(doc_id, batch, status): what the last stage of each document's last batch has left."""
        rows = self.ledger(self.stages[0].name).select("doc_id", "batch", self._state(0).alias("status"), "ok")
        for k, stage in enumerate(self.stages[1:], 1):
            step = self.ledger(stage.name).select("doc_id", "batch", F.col("ok").alias("__ok"), self._state(k).alias("__status"))
            rows = rows.join(step, ["doc_id", "batch"], "left").select("doc_id", "batch", F.coalesce("__status", "status").alias("status"), F.coalesce("__ok", F.lit(False)).alias("ok"))
        return rows.drop("ok")

    def _state(self, k: int) -> Column:
        return F.when(F.col("ok"), self.stages[k].done).otherwise(self.stages[k].failed)


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches in a folder."""
    return sorted(int(name.removeprefix("batch=")) for name in Q.folders_of(spark, folder) if name.startswith("batch="))


def graph_tables(texts: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """Entities, relations and a summary of each document from its mentions (merged with anchors): what a graph takes."""
    sentences = E.sentences(texts)
    relations = E.aggregate_evidence(E.sentence_relations(mentions, sentences).unionByName(E.window_relations(mentions, sentences)))
    ids = E.entity_ids(mentions)
    nodes = ids.select("doc_id", "id", F.array("type").alias("labels"), "text", "type", "confidence", F.col("doc_id").alias("document_id"))
    end = lambda name, to: ids.select("doc_id", F.col("text").alias(name), F.col("id").alias(to))
    edges = relations.join(end("head", "src"), ["doc_id", "head"]).join(end("tail", "dst"), ["doc_id", "tail"])
    edges = edges.select("doc_id", "src", F.col("relation").alias("rel_type"), "dst", "confidence", "evidence_count", F.col("doc_id").alias("document_id"))
    return {"nodes": nodes, "edges": edges, "extractions": E.summary(mentions.withColumn("linking_status", F.lit("nil")), relations)}


def file_stages(terms: Sequence[tuple], encode: Callable[[Column], Column] | None = None, nlist: int = 64, parts: int = 16) -> list[Stage]:
    """The stages of files, with the states that they leave (fixed values). terms: the dictionary of mentions; encode: texts to vectors."""
    encode = encode or Q.encoder()

    def structure(b: Batch) -> dict[str, DataFrame]:
        return {"blocks": S.blocks(text_elements(b.docs))}

    def vectors(b: Batch) -> dict[str, DataFrame]:
        units = S.content_units(b.table("blocks"))
        return {"vectors": units.withColumn("vector", encode(F.col("content"))).filter("vector is not null").withColumn("key", F.concat_ws(":", F.lit(b.number), "id"))}

    def index_vectors(b: Batch) -> None:
        rows, path, name = b.table("vectors").select(F.col("key").alias("id"), "vector"), f"{b.store.root}/vector_index", f"batch{b.number}"
        if exists(b.store.spark, f"{path}/model/_SUCCESS"):
            V.insert(V.opened(b.store.spark, path), rows, name)
        elif not rows.isEmpty():
            V.build(rows, path, nlist, parts, name=name)

    def search(b: Batch) -> dict[str, DataFrame]:
        return {"search_documents": S.search_documents(b.table("blocks"))}

    def index_search(b: Batch) -> None:
        path, name = f"{b.store.root}/search_index", f"batch{b.number}"
        if exists(b.store.spark, path) and (others := [p for p in Q.parts_of(b.store.spark, path) if p not in (f"part-{name}", f"part-{name}-gone")]):
            Q.delete_documents(Q.opened(b.store.spark, path, others), b.docs.select("doc_id"), path, f"{name}-gone")
        Q.add_documents(b.table("search_documents"), path, name)

    def graph(b: Batch) -> dict[str, DataFrame]:
        found = E.merge_with_anchors(E.resolve(E.scan(b.docs, terms)), E.statistical_entities(b.docs))
        return {"mentions": found}

    def save_graph(b: Batch) -> None:
        for name, rows in graph_tables(b.docs.select("doc_id", "text"), b.table("mentions")).items():
            rows.write.mode("overwrite").parquet(f"{b.store.root}/tables/{name}/batch={b.number}")

    def rows_of_tables(b: Batch) -> dict[str, DataFrame]:
        blocks = b.table("blocks")
        found = {"sections": S.sections(blocks), "figures": S.figure_rows(blocks), "tables": S.table_heads(blocks), "table_lines": S.table_lines(blocks)}
        owners = blocks.select("section_id", "doc_id").distinct()
        return {name: rows if "doc_id" in rows.columns else rows.join(owners, "section_id") for name, rows in found.items()}

    return [
        Stage("structure", "extracted", "extract_failed", structure, lambda b: b.table("blocks")),
        Stage("vectors", "vectorized", "vectorize_failed", vectors, lambda b: b.table("vectors"), index_vectors),
        Stage("search", "bm25_completed", "bm25_failed", search, lambda b: b.table("search_documents"), index_search),
        Stage("graph", "graph_completed", "graph_failed", graph, None, save_graph),
        Stage("tables", "completed", "mysql_failed", rows_of_tables),
    ]


def graph_of(store: Ingested) -> tuple[DataFrame, DataFrame]:
    """The graph of all documents: nodes and edges, merged, with documents and what they contain."""
    nodes = upsert_nodes(store.table("nodes", "graph").withColumnRenamed("batch", "version").drop("doc_id"))
    edges = upsert_edges(store.table("edges", "graph").withColumnRenamed("batch", "version").drop("doc_id"), nodes)
    return nodes, edges.unionByName(contains_edges(nodes), allowMissingColumns=True)


def search_vectors(store: Ingested, queries: DataFrame, k: int = 10, nprobe: int = 16, refine: int = 100) -> DataFrame:
    """The nearest content units (query_id, query_vector) that count: hits of replaced rows fall out before the best k are taken."""
    hits = V.search(V.opened(store.spark, f"{store.root}/vector_index"), queries, refine, nprobe, refine).withColumnRenamed("id", "key").drop("rank")
    return Q.top(hits.join(store.table("vectors", "vectors").drop("vector", "batch"), "key"), k, F.desc("score"), F.col("key"))


def start(documents: DataFrame, store: Ingested, checkpoint: str, every: str | None = None):
    """Ingest a stream of documents (doc_id, text, …). every: a trigger interval; without one, all there is and stop."""
    writer = documents.writeStream.foreachBatch(store.ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
