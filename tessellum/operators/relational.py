"""Catalogue statistics, listing, structure counts, mutation and lifecycle over relational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Progress, stage and label of each state of a file.
PROGRESS = {
    "pending": (10, "uploaded", "文件已上传"), "extracting": (25, "extracting", "内容提取中"), "extracted": (40, "extracted", "内容提取完成"), "vectorizing": (50, "vectorizing", "向量化处理中"), "vectorized": (60, "vectorized", "向量化完成"),
    "bm25_processing": (65, "bm25_processing", "BM25倒排处理中"), "bm25_completed": (70, "bm25_completed", "BM25倒排完成"), "graph_processing": (80, "graph_processing", "知识图谱构建中"), "graph_completed": (85, "graph_completed", "知识图谱构建完成"),
    "mysql_processing": (95, "mysql_processing", "MySQL保存中"), "completed": (100, "completed", "处理完成"), "extract_failed": (40, "extract_failed", "内容提取失败"), "vectorize_failed": (60, "vectorize_failed", "向量化失败"),
    "bm25_failed": (70, "bm25_failed", "BM25倒排失败"), "graph_failed": (85, "graph_failed", "知识图谱构建失败"), "mysql_failed": (95, "mysql_failed", "MySQL保存失败"), "process_failed": (0, "process_failed", "处理失败"),
}


def conjunction(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def equal_to(values: Mapping[str, object]) -> Column:
    """All given equalities; those whose value is None are left out."""
    return conjunction([F.col(k) == v for k, v in values.items() if v is not None])


def mentions(text: str, *columns: str) -> Column:
    """Whether any column contains the text, whatever the case and accents."""
    fold = lambda c: F.collate(c, "UNICODE_CI_AI")
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(fold(F.col(c)), fold(F.lit(text))), F.lit(False)) for c in columns])


def overview(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_count"), F.sum("file_size").alias("total_size"))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("total_count"), F.sum("file_size").alias("total_size"))


def by_status(files: DataFrame) -> DataFrame:
    return files.groupBy("process_status").agg(F.count("*").alias("total_count"))


def document_stats(files: DataFrame) -> DataFrame:
    status = F.col("process_status")
    return files.groupBy("file_type").agg(
        F.count("*").alias("total_count"), F.sum("file_size").alias("total_size"), F.round(F.avg("file_size"), 4).alias("avg_size"), F.count_if(status == "completed").alias("completed_count"),
        F.count_if(status == "pending").alias("pending_count"), F.count_if(status.like("%failed%")).alias("failed_count"),
    )


def status_shares(files: DataFrame) -> DataFrame:
    """Count and percentage of each state; the total comes from the few counts, not from the files again."""
    counts = files.groupBy("process_status").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("process_status", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percentage"))


def file_page(files: DataFrame, page: int = 1, page_size: int = 20, file_type: str | None = None, status: str | None = None, search: str | None = None) -> DataFrame:
    """One page of the newest files with the number of all that match and of pages; top-k and offset, no total sort."""
    page = max(page, 1)
    page_size = page_size if 1 <= page_size <= 100 else 20
    found = files.filter(equal_to({"file_type": file_type, "process_status": status}) & (mentions(search, "filename", "metadata") if search else F.lit(True)))
    total = found.agg(F.count("*").alias("total"))
    rows = found.select("id", "filename", "file_type", "file_size", "upload_time", "process_status").orderBy(F.desc("upload_time"), F.desc("id")).offset((page - 1) * page_size).limit(page_size)
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / page_size))


def structure_stats(files: DataFrame, sections: DataFrame, figures: DataFrame, tables: DataFrame, lines: DataFrame, doc_id: int | None = None) -> DataFrame:
    """Counts over the left joins of all children: sum and mean are over the joined rows, as multiplied by them.

    The joined rows aren't made: a table's figures and lines say how often it would stand in them. The
    different ids of each kind of child give rows of numbers, which one aggregate adds up by document."""
    rows = files if doc_id is None else files.filter(F.col("id") == doc_id)
    owner = sections.select(F.col("doc_id").alias("id"), "section_id")
    times = lambda n: F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))
    one = lambda key: F.col(key).isNotNull().cast("long")
    shown = figures.groupBy("section_id").agg(F.count("*").alias("shown"))
    long = lines.groupBy(F.col("table_elem_id").alias("tbl"), "row_index").agg(F.count("*").alias("n")).groupBy("tbl").agg(F.sum("n").alias("long"), F.count("row_index").alias("indexes"))
    heads = tables.select("section_id", F.col("elem_id").alias("tbl"), "n_rows", "n_cols").join(long, "tbl", "left").join(shown, "section_id", "left")
    heads = heads.select("section_id", "tbl", "n_rows", "n_cols", "indexes", (times(F.col("long")) * times(F.col("shown"))).alias("times"))
    of_sections = owner.distinct().select("id", one("section_id").alias("sections_count"))
    of_figures = owner.join(figures.select("section_id", F.col("elem_id").alias("figure")), "section_id").select("id", "figure").distinct().select("id", one("figure").alias("figures_count"))
    of_tables = owner.join(heads, "section_id").groupBy("id", "tbl").agg(
        F.max("indexes").alias("table_rows_count"), F.sum(F.col("n_rows") * F.col("times")).alias("n_rows"), F.sum(F.col("n_cols") * F.col("times")).alias("n_cols"), F.sum(F.when(F.col("n_cols").isNotNull(), F.col("times"))).alias("times"),
    ).select("id", one("tbl").alias("tables_count"), "table_rows_count", "n_rows", "n_cols", "times")
    every = of_sections.unionByName(of_figures, allowMissingColumns=True).unionByName(of_tables, allowMissingColumns=True)
    counts = every.groupBy("id").agg(*[F.sum(c).alias(c) for c in every.columns if c != "id"])
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.groupBy("id", "filename").agg(F.count("*").alias("copies")).join(counts, "id", "left").select(
        "id", "filename", none("sections_count"), none("figures_count"), none("tables_count"), none("table_rows_count"), (F.col("n_rows") * F.col("copies")).alias("total_table_rows"), F.round(F.col("n_cols") / F.col("times"), 4).alias("avg_table_cols"),
    )


def structure_stats_exact(files: DataFrame, sections: DataFrame, figures: DataFrame, tables: DataFrame, lines: DataFrame) -> DataFrame:
    """The same counts with every table counted once: each child is counted by document before it is joined."""
    owner = sections.select("section_id", F.col("doc_id").alias("id"))
    n = lambda df, *aggs: df.join(owner, "section_id").groupBy("id").agg(*aggs)
    out = files.select("id", "filename").join(owner.groupBy("id").agg(F.count("*").alias("sections_count")), "id", "left")
    out = out.join(n(figures, F.count("*").alias("figures_count")), "id", "left")
    out = out.join(n(tables, F.count("*").alias("tables_count"), F.sum("n_rows").alias("total_table_rows"), F.round(F.avg("n_cols"), 4).alias("avg_table_cols")), "id", "left")
    out = out.join(n(lines, F.count("*").alias("table_rows_count")), "id", "left")
    return out.fillna(0, ["sections_count", "figures_count", "tables_count", "table_rows_count"])


def figure_files(figures: DataFrame, sections: DataFrame, condition: Column) -> DataFrame:
    """Distinct rows (doc_id, image_path) of figures over their sections, where a condition on the document holds."""
    return figures.select("section_id", "image_path").join(sections.filter(condition).select("section_id", "doc_id"), "section_id").select("doc_id", "image_path").distinct()


def tables_with_rows(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Each table with its rows in order, by one join in place of a query for each."""
    rows = lines.groupBy("table_elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_text"))), lambda r: r["row_text"]).alias("row_texts"))
    return tables.join(rows, tables["elem_id"] == rows["table_elem_id"], "left").select("elem_id", "section_id", "n_rows", "n_cols", "row_texts")


def progress(status: Column) -> Column:
    cases = F.create_map(*[x for k, (p, stage, label) in PROGRESS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("progress"), F.lit(stage).alias("stage"), F.lit(label).alias("stage_name")))])
    unknown = F.struct(F.lit(0).alias("progress"), F.lit("unknown").alias("stage"), F.lit("未知状态").alias("stage_name"))
    return F.coalesce(F.try_element_at(cases, status), unknown)


def first_uploads(files: DataFrame) -> DataFrame:
    """For each file the id of the first one with its content."""
    first = files.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return files.select("id", "content_hash").join(first, "content_hash").select("id", "first_id", "copies", (F.col("id") == F.col("first_id")).alias("is_first"))


def updated(rows: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE: new values where the condition holds."""
    return rows.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(rows: DataFrame, condition: Column) -> DataFrame:
    """What DELETE leaves: rows where the condition is false or null."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def upserted(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `more` in place of those with the same keys."""
    return rows.join(more.select(*keys).distinct(), list(keys), "left_anti").unionByName(more)


def cascade(ids: DataFrame, tables: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What stays in each table (name: (rows, column of the document's id)) after documents are deleted."""
    return {name: rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti") for name, (rows, key) in tables.items()}


def deletion_log(gone: DataFrame) -> DataFrame:
    return gone.select(F.lit("document_delete").alias("operation_type"), F.concat(F.lit("document_id:"), "id").alias("operation_target"), F.concat(F.lit("filename:"), "filename", F.lit(", file_size:"), "file_size").alias("operation_detail"), F.lit("success").alias("status"))


def unexpired(logs: DataFrame, now: Column, days: int) -> DataFrame:
    return deleted(logs, F.col("created_at") < now - F.make_dt_interval(F.lit(days)))


def query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised SELECT over frames by their names."""
    return spark.sql(sql, args=dict(args) if args else None, **views)


def matches_schema(df: DataFrame, required: T.StructType) -> bool:
    """Whether a stored table has all required fields in their types; otherwise it has to be built anew."""
    have = {f.name: f.dataType for f in df.schema}
    return all(have.get(f.name) == f.dataType for f in required)


def stale_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files of a binaryFile source that are older than so many hours."""
    return files.filter(F.col("modificationTime") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
