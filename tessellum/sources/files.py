"""Files of a folder as layout elements: web pages and plain texts; kinds that need a layout model give none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions.text import decoded, extension
from tessellum.sources.fixtures import html_elements, text_elements

HTML, PLAIN = ("html", "htm"), ("txt", "md")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Rows (path, modificationTime, length, content) of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def partition_files(files: DataFrame) -> DataFrame:
    """Elements (path, elem_index, elem_type, text, page) of files (path, content), by their extensions.

    Bytes are UTF-8, or GBK where they are no UTF-8. Empty files and files of other kinds give no elements."""
    rows = files.select("path", extension(F.col("path")).alias("kind"), decoded(F.col("content")).alias("text"))
    pages = html_elements(rows.filter(F.col("kind").isin(*HTML)).select(F.col("path").alias("page_id"), F.col("text").alias("html")))
    plain = text_elements(rows.filter(F.col("kind").isin(*PLAIN)).select(F.col("path").alias("doc_id"), "text"))
    columns = ["elem_index", "elem_type", "text", "page"]
    return pages.withColumn("page", F.lit(1)).select(F.col("page_id").alias("path"), *columns).unionByName(plain.select(F.col("doc_id").alias("path"), *columns))
