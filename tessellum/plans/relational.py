"""Queries on the catalogue, its statistics and its lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as X
from tessellum.operators import relational as R
from tessellum.operators import structure as S
from tessellum.plans.sql import BLOCKS, CATALOGUE, SECTIONS
from tessellum.sources.fixtures import catalogue, table, text_elements


def _files(spark, sf_dir):
    return catalogue(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _children(spark, sf_dir):
    blocks = S.blocks(text_elements(table(spark, sf_dir, "documents")))
    return S.sections(blocks), S.figure_rows(blocks), S.table_heads(blocks), S.table_lines(blocks)


def file_catalogue(spark, sf_dir):
    return _files(spark, sf_dir)


def stats_overview(spark, sf_dir):
    return R.overview(_files(spark, sf_dir))


def stats_by_type(spark, sf_dir):
    return R.by_type(_files(spark, sf_dir))


def stats_by_status(spark, sf_dir):
    return R.by_status(_files(spark, sf_dir))


def document_stats(spark, sf_dir):
    return R.document_stats(_files(spark, sf_dir))


def status_shares(spark, sf_dir):
    return R.status_shares(_files(spark, sf_dir))


def file_list_page(spark, sf_dir):
    return R.file_page(_files(spark, sf_dir), page=2, page_size=15, file_type="en", status="completed")


def file_list_search(spark, sf_dir):
    return R.file_page(_files(spark, sf_dir), page_size=50, search="SRC1")


def file_by_hash(spark, sf_dir):
    files = _files(spark, sf_dir)
    wanted = files.filter("id = 5").select("content_hash")
    return files.join(wanted, "content_hash", "left_semi").orderBy("id").limit(1).select("id", "filename", "content_hash")


def structure_stats(spark, sf_dir):
    return R.structure_stats(_files(spark, sf_dir), *_children(spark, sf_dir))


def structure_stats_of_one(spark, sf_dir):
    return R.structure_stats(_files(spark, sf_dir), *_children(spark, sf_dir), doc_id=28)


def structure_stats_exact(spark, sf_dir):
    return R.structure_stats_exact(_files(spark, sf_dir), *_children(spark, sf_dir))


def tables_with_rows(spark, sf_dir):
    _, _, tables, lines = _children(spark, sf_dir)
    return R.tables_with_rows(tables, lines).withColumn("row_texts", F.array_join("row_texts", "\n"))


def file_progress(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.select("id", R.progress(F.col("process_status")).alias("p")).select("id", "p.*")


def first_uploads(spark, sf_dir):
    return R.first_uploads(_files(spark, sf_dir))


def upload_validation(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" a:b/"), "source", F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".exe").otherwise("")).alias("name"), (F.col("n_chars") * 40_000).alias("size"))
    return names.select("doc_id", X.safe_name(F.col("name")).alias("safe"), X.extension(F.col("name")).alias("ext"), X.allowed_upload(F.col("name"), F.col("size")).alias("allowed"), F.substring(F.md5("name"), 1, 8).alias("name_hash"))


def status_update(spark, sf_dir):
    late = (F.col("process_status") == "pending") & (F.col("file_size") > 3000)
    return R.updated(_files(spark, sf_dir), late, {"process_status": F.lit("process_failed")}).groupBy("process_status").agg(F.count("*").alias("n"))


def cascade_delete(spark, sf_dir):
    files = _files(spark, sf_dir)
    sections, _, tables, lines = _children(spark, sf_dir)
    gone = files.filter("process_status like '%failed%'").select("id")
    kept = R.cascade(gone, {"documents": (files, "id"), "sections": (sections, "doc_id"), "tables": (tables, "doc_id")})
    kept["table_rows"] = lines.join(kept["tables"].select(F.col("elem_id").alias("table_elem_id")), "table_elem_id", "left_semi")
    counts = [rows.agg(F.lit(name).alias("kept_in"), F.count("*").alias("n")) for name, rows in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def deletion_log(spark, sf_dir):
    return R.deletion_log(_files(spark, sf_dir).filter("process_status = 'extract_failed'"))


def log_retention(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"))
    return R.unexpired(logs, F.lit("2024-01-31 00:00:00").cast("timestamp"), 14).agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


def parameterised_query(spark, sf_dir):
    sql = "select file_type, count(*) as n, max(file_size) as largest from {files} where file_size >= :least group by file_type"
    return R.query(spark, sql, {"least": 500}, files=_files(spark, sf_dir))


def _names(ids, files):
    stems = files.select(F.col("id").alias("document_id"), F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"))
    return ids.join(stems, "document_id", "left").groupBy("document_id").agg(F.coalesce(F.max("stem"), F.concat(F.lit("文档"), F.col("document_id").cast("string"))).alias("name"), F.count("*").alias("vectors"))


def _vector_documents(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 200).alias("document_id"))


def document_names(spark, sf_dir):
    """The stem of each vector's document, or a default name."""
    return _names(_vector_documents(spark, sf_dir), _files(spark, sf_dir))


def batch_tally(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count_if(F.col("process_status") == "completed").alias("succeeded"), F.count_if(F.col("process_status") != "completed").alias("failed"), F.count("*").alias("total"))


def supplier_part_outline(spark, sf_dir):
    """The left join chain and fan-out counts of the structure statistics over the star schema."""
    nation, supplier, line = (table(spark, sf_dir, t) for t in ("nation", "supplier", "lineitem"))
    parts = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"], "left").join(parts, "s_suppkey", "left")
    return joined.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.sum("lines").alias("lines"), F.round(F.sum("quantity"), 2).alias("quantity"))


def order_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        file_catalogue, stats_overview, stats_by_type, stats_by_status, document_stats, status_shares, file_list_page, file_list_search, file_by_hash, structure_stats, structure_stats_of_one, structure_stats_exact,
        tables_with_rows, file_progress, first_uploads, upload_validation, status_update, cascade_delete, deletion_log, log_retention, parameterised_query, document_names, batch_tally, supplier_part_outline, order_page,
    )
}

_CAT = f"with {CATALOGUE} "
_TABLES = f"""with {SECTIONS}, {CATALOGUE},
t as (select doc_id, section_id, section_id || '_' || elem_id as elem_id, 1 as n_rows, 2 as n_cols, text from b where type = 'table'),
joined as (select cat.id, cat.filename, s.section_id, t.elem_id as tbl, t.n_rows, t.n_cols from cat left join s on s.doc_id = cat.id left join t using (section_id))"""
_STATS = "select id, filename, count(distinct section_id) as sections_count, cast(0 as bigint) as figures_count, count(distinct tbl) as tables_count, count(distinct tbl) as table_rows_count, cast(sum(n_rows) as bigint) as total_table_rows, round(avg(n_cols), 4) as avg_table_cols from joined"
_PROGRESS = " ".join(f"when '{k}' then {p}" for k, (p, _, _) in R.PROGRESS.items())
_LABEL = " ".join(f"when '{k}' then '{label}'" for k, (_, _, label) in R.PROGRESS.items())
_STAGE = " ".join(f"when '{k}' then '{stage}'" for k, (_, stage, _) in R.PROGRESS.items())

ORACLES = {
    "file_catalogue": _CAT + "select * from cat",
    "stats_overview": _CAT + "select count(*) as total_count, cast(sum(file_size) as bigint) as total_size from cat",
    "stats_by_type": _CAT + "select file_type, count(*) as total_count, cast(sum(file_size) as bigint) as total_size from cat group by all",
    "stats_by_status": _CAT + "select process_status, count(*) as total_count from cat group by all",
    "document_stats": _CAT + "select file_type, count(*) as total_count, cast(sum(file_size) as bigint) as total_size, round(avg(file_size), 4) as avg_size, count(*) filter (process_status = 'completed') as completed_count, count(*) filter (process_status = 'pending') as pending_count, count(*) filter (process_status like '%failed%') as failed_count from cat group by file_type",
    "status_shares": _CAT + "select process_status, count(*) as count, round(cast(count(*) * 100.0 as double) / (select count(*) from cat), 2) as percentage from cat group by process_status",
    "file_list_page": _CAT + ", f as (select * from cat where file_type = 'en' and process_status = 'completed') select id, filename, file_type, file_size, upload_time, process_status, (select count(*) from f) as total, cast(ceil((select count(*) from f) / 15) as bigint) as total_pages from f order by upload_time desc, id desc limit 15 offset 15",
    "file_list_search": _CAT + ", f as (select * from cat where contains(lower(filename), 'src1') or contains(lower(metadata), 'src1')) select id, filename, file_type, file_size, upload_time, process_status, (select count(*) from f) as total, cast(ceil((select count(*) from f) / 50) as bigint) as total_pages from f order by upload_time desc, id desc limit 50",
    "file_by_hash": _CAT + "select id, filename, content_hash from cat where content_hash = (select content_hash from cat where id = 5) order by id limit 1",
    "structure_stats": f"{_TABLES} {_STATS} group by id, filename",
    "structure_stats_of_one": f"{_TABLES} {_STATS} where id = 28 group by id, filename",
    "structure_stats_exact": f"{_TABLES} {_STATS} group by id, filename",
    "tables_with_rows": f"with {BLOCKS} select section_id || '_' || elem_id as elem_id, section_id, 1 as n_rows, 2 as n_cols, text as row_texts from b where type = 'table'",
    "file_progress": f"{_CAT} select id, case process_status {_PROGRESS} else 0 end as progress, case process_status {_STAGE} else 'unknown' end as stage, case process_status {_LABEL} else '未知状态' end as stage_name from cat",
    "first_uploads": _CAT + "select id, min(id) over (partition by content_hash) as first_id, count(*) over (partition by content_hash) as copies, id = min(id) over (partition by content_hash) as is_first from cat",
    "upload_validation": "with n as (select doc_id, ' a:b/' || source || case doc_id % 3 when 0 then '.PDF' when 1 then '.exe' else '' end as name, n_chars * 40000 as size from documents) select doc_id, 'a_b_' || name[6:] as safe, case doc_id % 3 when 0 then 'pdf' when 1 then 'exe' end as ext, doc_id % 3 = 0 and size <= 104857600 as allowed, md5(name)[1:8] as name_hash from n",
    "status_update": _CAT + "select case when process_status = 'pending' and file_size > 3000 then 'process_failed' else process_status end as process_status, count(*) as n from cat group by 1",
    "cascade_delete": f"{_TABLES}, kept as (select id from cat where process_status not like '%failed%') select 'documents' as kept_in, count(*) as n from kept union all select 'sections', count(*) from s where doc_id in (from kept) union all select 'tables', count(*) from t where doc_id in (from kept) union all select 'table_rows', count(*) from t where doc_id in (from kept)",
    "deletion_log": _CAT + "select 'document_delete' as operation_type, 'document_id:' || id as operation_target, 'filename:' || filename || ', file_size:' || file_size as operation_detail, 'success' as status from cat where process_status = 'extract_failed'",
    "log_retention": "select count(*) as kept, min(event_id) as first_id from events where ts >= timestamp '2024-01-31' - interval 14 day",
    "parameterised_query": _CAT + "select file_type, count(*) as n, max(file_size) as largest from cat where file_size >= 500 group by file_type",
    "document_names": _CAT + "select v.document_id, coalesce(max('doc_' || v.document_id) filter (cat.id is not null), '文档' || v.document_id) as name, count(*) as vectors from (select vec_id % 200 as document_id from embeddings) v left join cat on cat.id = v.document_id group by v.document_id",
    "batch_tally": _CAT + "select count(*) filter (process_status = 'completed') as succeeded, count(*) filter (process_status <> 'completed') as failed, count(*) as total from cat",
    "supplier_part_outline": "with p as (select l_suppkey as s_suppkey, count(*) as lines, sum(l_quantity) as quantity from lineitem group by 1) select n_name, count(s_suppkey) as suppliers, cast(sum(lines) as bigint) as lines, round(sum(quantity), 2) as quantity from nation left join supplier on n_nationkey = s_nationkey left join p using (s_suppkey) group by n_name",
    "order_page": "select o_orderkey, o_custkey, o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 20 offset 40",
}
