"""Tables in a folder, changed as a whole: the vector store, the search index's documents, JSON documents, and what a deletion takes.

A store keeps each version of a table in a folder of its own and names the current ones in one manifest.
A change writes new versions beside the old ones and then swaps the manifest by one rename, so readers see
all of a change or nothing of it, however many tables it has, and a job that is lost leaves the store as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.operators.relational import matches_schema, upserted

#: The fields of a vector collection.
VECTOR_FIELDS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("document_id", T.LongType()), T.StructField("element_id", T.StringType()),
    T.StructField("chunk_index", T.LongType()), T.StructField("content", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("metadata", T.StringType()),
])
MOST_ELEMENT_ID = 100


class Store:
    """Named tables under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(context._jsc.hadoopConfiguration())

    def manifest(self) -> dict[str, dict]:
        """Path and schema of each table."""
        where = self._path(f"{self.root}/manifest.json")
        if not self._system.exists(where):
            return {}
        rows = self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).first()
        return json.loads(rows[0]) if rows else {}

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str) -> DataFrame:
        entry = self.manifest()[name]
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def describe(self, name: str) -> DataFrame:
        """Rows (col_name, data_type), in the table's order."""
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.read(name).schema], "col_name string, data_type string")

    def size(self) -> int:
        """Bytes of the current versions."""
        return sum(self._system.getContentSummary(self._path(t["path"])).getLength() for t in self.manifest().values())

    def commit(self, changes: Mapping[str, DataFrame], drop: tuple[str, ...] = (), partition_by: Mapping[str, str] | None = None) -> None:
        """Write new versions of some tables, then swap the manifest. Old versions stay for readers that have begun."""
        now = self.manifest()
        for name, df in changes.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            column = (partition_by or {}).get(name)
            (df.write.partitionBy(column) if column else df.write).parquet(path)
            self._system.mkdirs(self._path(path))  # an empty table with partitions writes no folder
            now[name] = {"path": path, "schema": T.StructType([f for f in df.schema if f.name != column] + [f for f in df.schema if f.name == column]).jsonValue()}
        for name in drop:
            now.pop(name, None)
        staged, final = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest.json")
        stream = self._system.create(staged)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        context = self.spark.sparkContext
        kind = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = context._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), context._jsc.hadoopConfiguration()).rename(staged, final, options)

    def append(self, name: str, rows: DataFrame) -> None:
        """INSERT of many rows at once; the table is made where there is none."""
        self.commit({name: self.read(name).unionByName(rows) if self.exists(name) else rows})


def collection(store: Store, name: str) -> bool:
    """Make a vector collection where there is none or its fields are others; whether it was made."""
    if store.exists(name) and matches_schema(store.read(name), VECTOR_FIELDS):
        return False
    store.commit({name: store.spark.createDataFrame([], VECTOR_FIELDS)}, partition_by={name: "content_type"})
    return True


def vector_fields(rows: DataFrame) -> DataFrame:
    """Rows as a collection has them: a missing kind comes from the metadata or is `fragment`, missing fields are null.

    Ids that are no strings, and element ids that are too long, are refused."""
    if not isinstance(rows.schema["id"].dataType, T.StringType):
        raise ValueError(f"ids have to be strings, not {rows.schema['id'].dataType.simpleString()}")
    have = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
    out = rows.select(*[have(f).alias(f.name) for f in VECTOR_FIELDS])
    kind = F.coalesce("content_type", F.get_json_object("metadata", "$.content_type"), F.lit("fragment"))
    checked = F.when(F.length("element_id") > MOST_ELEMENT_ID, F.raise_error(F.concat(F.lit("element id too long: "), "element_id"))).otherwise(F.col("element_id"))
    return out.withColumn("content_type", kind).withColumn("element_id", checked)


def changed_vectors(store: Store, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write what a change makes of a collection, in partitions by kind."""
    collection(store, name)
    store.commit({name: change(store.read(name)).select(VECTOR_FIELDS.names)}, partition_by={name: "content_type"})


def insert_vectors(store: Store, name: str, rows: DataFrame) -> None:
    changed_vectors(store, name, lambda old: old.unionByName(vector_fields(rows)))


def update_vectors(store: Store, name: str, rows: DataFrame) -> None:
    """Rows in place of those with their ids."""
    changed_vectors(store, name, lambda old: upserted(old.select(VECTOR_FIELDS.names), vector_fields(rows), ["id"]))


def delete_vectors(store: Store, name: str, condition: Column) -> None:
    changed_vectors(store, name, lambda old: old.filter(~F.coalesce(condition, F.lit(False))))


def vectors_by_id(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of ids (id)."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def document_json(documents: DataFrame, folder: str) -> None:
    """One folder of JSON lines, a document each, in UTF-8."""
    documents.write.mode("overwrite").json(folder)


def first_found(candidates: DataFrame, names: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """For each row of candidates (id, and a name in each column of order) the first of its names that is in names (name)."""
    known = names.select("name").distinct()
    rows = candidates.select("id", F.posexplode(F.array(*order)).alias("rank", "name")).join(known, "name")
    return candidates.select("id").join(rows.groupBy("id").agg(F.min_by("name", "rank").alias("name")), "id", "left")


#: The steps of a deletion, and how many have to go well.
STEPS, ENOUGH = ("vectors", "search", "graph", "files", "processed_files", "relational", "log"), 4


def deletion_outcome(steps: DataFrame) -> DataFrame:
    """Rows (id, done, success) from (id, step, ok): a deletion stands if enough of its steps do."""
    return steps.groupBy("id").agg(F.count_if(F.col("ok") & F.col("step").isin(*STEPS)).alias("done")).withColumn("success", F.col("done") >= ENOUGH)


def delete_everywhere(gone: DataFrame, vectors: DataFrame, search: DataFrame, nodes: DataFrame, edges: DataFrame, relational: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What stays in every store after documents (id) are deleted: vectors, search documents, entities with their edges, and relational rows."""
    ids = gone.select("id").distinct()
    without = lambda rows, key: rows.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    lost = nodes.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    kept_edges = edges
    for end in ("src", "dst"):
        kept_edges = kept_edges.join(lost.select(F.col("id").alias(end)), end, "left_anti")
    out = {"vectors": without(vectors, "document_id"), "search": without(search, "doc_id"), "nodes": nodes.join(lost, "id", "left_anti"), "edges": kept_edges}
    return out | {name: without(rows, key) for name, (rows, key) in relational.items()}
