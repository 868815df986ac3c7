"""The engine's tables made of the driver's: elements, catalogue, vectors, status events, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions.text import blank

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_elements(docs: DataFrame) -> DataFrame:
    """Elements of plain texts: a line each; lines with a pipe are tables, short ones titles."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("elem_index", "text"))
    kind = F.when(F.contains("text", F.lit("|")), "Table").when(F.length("text") <= 40, "Title").otherwise("NarrativeText")
    return lines.filter(~blank(F.col("text"))).select("doc_id", "elem_index", kind.alias("elem_type"), "text", (F.floor(F.col("elem_index") / 10) + 1).cast("int").alias("page"))


def html_elements(pages: DataFrame) -> DataFrame:
    """Elements of web pages in their order: h1 is a title, li a list item, p a paragraph; entities and tags are dropped."""
    pattern = r"(?is)<(h1|li|p)\b[^>]*>(.*?)</\1>"
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h1|li|p)\b[^>]*>.*?</(?:h1|li|p)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("elem_index", "raw"))
    tag = F.lower(F.regexp_extract("raw", pattern, 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", pattern, 2), r"(?s)<[^>]*>", " "), r"\s+", " "))
    kind = F.when(tag == "h1", "Title").when(tag == "li", "ListItem").otherwise("NarrativeText")
    return rows.select("page_id", "elem_index", kind.alias("elem_type"), text.alias("text")).filter("text <> ''")


def catalogue(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The file table: type from lang, size from n_chars, status from quality, hash of the text."""
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "extract_failed").otherwise("pending")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), "doc_id", F.lit("."), "lang").alias("filename"), F.col("lang").alias("file_type"), F.col("n_chars").alias("file_size"),
        F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + F.col("doc_id") * 60).alias("upload_time"), status.alias("process_status"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("metadata"),
    )


def vector_rows(embeddings: DataFrame, n_docs: int) -> DataFrame:
    kind = F.when(F.col("label") <= 2, "title").when(F.col("label") <= 4, "section").otherwise("fragment")
    return embeddings.select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % n_docs).alias("document_id"), kind.alias("content_type"))


def benchmark_queries(benchmark: DataFrame, words: int = 5) -> DataFrame:
    """The first words of each item, as queries."""
    return benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, words), " ").alias("query"))


def status_events(events: DataFrame) -> DataFrame:
    """A stream of file states: users are files, kinds of events are states."""
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "extract_failed").when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "extracting").otherwise("vectorizing")
    return events.select(F.col("user_id").alias("file_id"), state.alias("status"), "ts", "event_id")
