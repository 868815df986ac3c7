"""Queries on stores, deletions, figures, and the small operators of pages and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as X
from tessellum.operators import answer as A
from tessellum.operators import extraction as E
from tessellum.operators import relational as R
from tessellum.operators import stores as T
from tessellum.operators import structure as S
from tessellum.plans.graph import _G, _graph
from tessellum.plans.relational import _children, _files
from tessellum.plans.sql import BLOCKS, CATALOGUE, SECTIONS
from tessellum.sources.fixtures import table, text_elements
from tessellum.sources.scratch import fresh_path
from tessellum.streaming.status import staged


def _vector_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    meta = F.when(F.col("label") < 5, F.to_json(F.struct(F.concat(F.lit("kind"), "label").alias("content_type")))).otherwise(F.lit("{}"))
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 40).alias("document_id"), F.concat(F.lit("e"), "vec_id").alias("element_id"), F.when(F.col("label") == 9, "title").alias("content_type"), meta.alias("metadata"))


def vector_collection(spark, sf_dir):
    """A collection after an insert, an update of half of it, and the deletion of one document: what it has by kind, found by id."""
    store = T.Store(spark, fresh_path(spark, "store"))
    rows = _vector_rows(spark, sf_dir)
    T.insert_vectors(store, "vectors", rows)
    T.update_vectors(store, "vectors", rows.filter("document_id < 20").withColumn("content_type", F.lit("changed")))
    T.delete_vectors(store, "vectors", F.col("document_id") == 7)
    found = T.vectors_by_id(store.read("vectors"), rows.select("id"))
    return found.groupBy("content_type").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.size("vector")).alias("numbers"))


def store_tables(spark, sf_dir):
    """Two tables put into a store in one change, and a third by appends: their columns, as described."""
    store = T.Store(spark, fresh_path(spark, "store"))
    store.commit({"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")})
    store.append("added", table(spark, sf_dir, "region"))
    store.append("added", table(spark, sf_dir, "region").withColumn("r_name", F.lower("r_name")))
    store.commit({}, drop=("region",))
    described = [store.describe(name).withColumn("table", F.lit(name)).crossJoin(store.read(name).agg(F.count("*").alias("n"))) for name in store.tables()]
    return described[0].unionByName(described[1]).withColumn("has_region", F.lit(store.exists("region")))


def deletion_everywhere(spark, sf_dir):
    """What stays in every store after the documents that failed are deleted."""
    files = _files(spark, sf_dir)
    sections, _, tables, _ = _children(spark, sf_dir)
    docs = S.search_documents(S.blocks(text_elements(table(spark, sf_dir, "documents"))))
    nodes, edges = _graph(spark, sf_dir)
    gone = files.filter("process_status = 'extract_failed'").select("id")
    kept = T.delete_everywhere(gone, _vector_rows(spark, sf_dir), docs, nodes, edges, {"documents": (files, "id"), "sections": (sections, "doc_id"), "tables": (tables, "doc_id")})
    counts = [rows.agg(F.lit(name).alias("kept_in"), F.count("*").alias("n")) for name, rows in sorted(kept.items())]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def deletion_outcomes(spark, sf_dir):
    steps = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.array(*map(F.lit, T.STEPS))).alias("k", "step"))
    return T.deletion_outcome(steps.withColumn("ok", (F.col("id") + F.col("k")) * F.col("k") % 5 < 3))


def _figures(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    point = lambda i, scale: F.struct((F.col("embedding")[i] * scale + 300).cast("double").alias("x"), (F.col("embedding")[i + 1] * scale + 300).cast("double").alias("y"))
    points = F.when(F.col("label") == 0, F.array(point(0, 100))).otherwise(F.array(point(0, 100), point(2, 50), point(4, 200)))
    return rows.select((F.col("vec_id") % 40).alias("doc_id"), F.floor(F.col("vec_id") / 40).cast("int").alias("elem_index"), F.lit("Image").alias("elem_type"), F.concat(F.lit("figure "), "vec_id").alias("text"), F.when(F.col("label") != 3, F.col("label") + 1).alias("page"), points.alias("points"), F.concat(F.lit("img"), F.col("vec_id") % 7, F.lit(".png")).alias("image_path"))


def figure_rows(spark, sf_dir):
    """Figures with caption, page, path and the box as shares of the page."""
    rows = S.figure_rows(S.blocks(_figures(spark, sf_dir)))
    return rows.select("section_id", "elem_id", "image_path", "caption", "page", *[F.col(f"bbox_norm.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], S.image_path(F.col("section_id"), F.col("page"), F.regexp_extract("elem_id", "([0-9]+)$", 1).cast("int"), F.lit("0")).alias("renamed"))


def figure_files(spark, sf_dir):
    """The distinct picture files of documents, over their sections."""
    rows = S.blocks(_figures(spark, sf_dir))
    return R.figure_files(S.figure_rows(rows), S.sections(rows), F.col("doc_id") > 3)


def table_markup(spark, sf_dir):
    """HTML of tables: as it comes with another class, with none, with text alone."""
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<p>x</p><table id="a" class="old"><tr><th>a</th><td>b</td></tr></table><table class="b">'), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<table><tr><td>"), "url", F.lit("</td></tr></table>")))
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("html"), "url")
    return rows.select("page_id", S.table_html(F.col("html"), F.col("url")).alias("html"), S.html_columns(F.col("html")).alias("n_cols"))


def table_row_texts(spark, sf_dir):
    fields = F.map_from_arrays(F.array(F.lit("name"), F.lit("row_text"), F.lit("segment"), F.lit("empty")), F.array("c_name", "c_name", "c_mktsegment", F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.row_text(fields).alias("row_text"))


def json_documents(spark, sf_dir):
    """Documents written as JSON and read back: marks beyond ASCII stay."""
    folder = fresh_path(spark, "json")
    T.document_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), folder)
    return spark.read.schema("doc_id long, text string, lang string").json(folder).select("doc_id", F.md5("text").alias("text_md5"), "lang")


def json_paths(spark, sf_dir):
    """The first of three names of each document's file that is there."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[F.concat(F.lit(p), "doc_id", F.lit(".json")).alias(c) for c, p in (("a", "name_doc_"), ("b", "doc_"), ("c", ""))])
    there = docs.select(F.when(F.col("id") % 4 == 0, F.array("a", "c")).when(F.col("id") % 4 == 1, F.array("c")).when(F.col("id") % 4 == 2, F.array("b", "c")).otherwise(F.array().cast("array<string>")).alias("names")).select(F.explode("names").alias("name"))
    return T.first_found(docs, there, ("a", "b", "c"))


def decoded_texts(spark, sf_dir):
    """Bytes in UTF-8, and bytes that are none, as previews show them."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.unhex(F.lit("B2E2CAD4")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.decoded(raw)).alias("text_md5"))


def stale_files(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modificationTime"))
    return R.stale_files(files, F.lit("2024-01-20 00:00:00").cast("timestamp"), 48).agg(F.count("*").alias("stale"), F.max("event_id").alias("last_id"))


def timeouts(spark, sf_dir):
    given = F.when(F.col("p_size") % 4 == 0, F.concat("p_size", F.lit("s"))).when(F.col("p_size") % 4 == 1, F.concat("p_size", F.lit(".5m"))).when(F.col("p_size") % 4 == 2, F.concat("p_size", F.lit("h"))).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "part").select("p_partkey", X.timeout_seconds(given).alias("seconds"))


def lexicon_terms(spark, sf_dir):
    """The dictionary of parts: names with their aliases, the last of equal terms."""
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("canonical"), F.when(F.col("p_size") % 2 == 0, "Protein").otherwise("Other").alias("type"), F.array("p_brand", F.concat("p_brand", F.lit("－１"))).alias("aliases"))
    return E.lexicon(entries)


def page_uploads(spark, sf_dir):
    name = F.concat("source", F.when(F.col("doc_id") % 4 == 0, ".PDF").when(F.col("doc_id") % 4 == 1, ".png").when(F.col("doc_id") % 4 == 2, ".tar.md").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.page_upload(name, F.col("n_chars") * 40_000).alias("taken"), X.allowed_upload(name, F.col("n_chars") * 40_000).alias("allowed"))


def inline_references(spark, sf_dir):
    text = F.concat(F.lit("see [图片:"), "url", F.lit("] and [表格:t"), "page_id", F.lit("], not [图:x] [图表:]"))
    return table(spark, sf_dir, "pages").select("page_id", X.inline_references(text).alias("text"))


def nation_tables(spark, sf_dir):
    """The nations of each region as the page's HTML table."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])).alias("rows"))
    joined = table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("r_regionkey", X.html_table(F.array(F.lit("key"), F.lit("name")), F.col("rows")).alias("html"))


def files_in_process(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(X.in_process(F.col("process_status")).alias("in_process")).agg(F.count("*").alias("n"))


def valid_queries(spark, sf_dir):
    """Whether texts can be queries: not blank, 1000 characters at most."""
    c = F.when(F.col("doc_id") % 9 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.valid_query(c).alias("valid"))


def status_codes(spark, sf_dir):
    """The states of files as a table of literals, one SELECT each put together."""
    rows = None
    for name, (share, stage, label) in R.PROGRESS.items():
        one = spark.range(1).select(F.lit(name).alias("status"), F.lit(share).alias("progress"), F.lit(stage).alias("stage"), F.lit(label).alias("label"))
        rows = one if rows is None else rows.union(one)
    return rows


def ingestion_states(spark, sf_dir):
    """States of files after staged ingestion that stops at the first failure."""
    docs = table(spark, sf_dir, "documents")
    states = staged({"extract_failed": ~X.blank(F.col("text")), "vectorize_failed": F.col("n_chars") <= 5000, "bm25_failed": F.size(X.tokens(F.col("text"))) > 3, "graph_failed": F.col("lang") != "es"})
    return docs.select(states.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def section_references(spark, sf_dir):
    """Reference lines of the documents that each word of a region's name leads to, in the order in which they are met."""
    blocks = S.blocks(text_elements(table(spark, sf_dir, "documents")))
    hits = S.sections(blocks).select((F.col("doc_id") % 10).alias("query_id"), F.concat(F.lit("doc_"), "doc_id").alias("doc_name"), "title", F.col("page_start").alias("page"), (F.col("doc_id") * 10 + F.col("section_no")).alias("arrival"), F.when(F.col("n_blocks") > 3, "table").when(F.col("n_blocks") > 2, "image").alias("media"))
    return A.references(hits)


QUERIES = {
    f.__name__: f
    for f in (
        vector_collection, store_tables, deletion_everywhere, deletion_outcomes, figure_rows, figure_files, table_markup, table_row_texts, json_documents, json_paths, decoded_texts, stale_files, timeouts, lexicon_terms, page_uploads,
        inline_references, nation_tables, files_in_process, valid_queries, status_codes, ingestion_states, section_references,
    )
}

_STATES = ", ".join(f"('{k}', {p}, '{s}', '{n}')" for k, (p, s, n) in R.PROGRESS.items())
_FIG = """fig as (
  select vec_id % 40 as doc_id, cast(floor(vec_id / 40) as int) as elem_index, 'figure ' || vec_id as caption, case when label <> 3 then label + 1 else 1 end as page, 'img' || (vec_id % 7) || '.png' as image_path, label, embedding as v from embeddings),
fg as (
  select *, doc_id || '_doc#2024-01-01#' || doc_id || '_0001' as section_id, doc_id || '_doc#2024-01-01#' || doc_id || '_0001_fig_' || row_number() over (partition by doc_id order by elem_index) as elem_id,
    case when label = 0 then 0 else trunc(cast(v[1] as double) * 100 + 300) end as x1, case when label = 0 then 0 else trunc(cast(v[2] as double) * 100 + 300) end as y1,
    case when label = 0 then 0 else trunc(cast(v[5] as double) * 200 + 300) end as x2, case when label = 0 then 0 else trunc(cast(v[6] as double) * 200 + 300) end as y2 from fig)"""

ORACLES = {
    "vector_collection": """with v as (select vec_id, vec_id % 40 as document_id, case when vec_id % 40 < 20 then 'changed' when label = 9 then 'title' when label < 5 then 'kind' || label else 'fragment' end as content_type, embedding from embeddings where vec_id % 40 <> 7)
select content_type, count(*) as n, count(distinct document_id) as documents, cast(sum(vec_id) as bigint) as ids, cast(sum(len(embedding)) as bigint) as numbers from v group by content_type""",
    "store_tables": "select * from (values ('r_regionkey', 'int', 'added'), ('r_name', 'string', 'added'), ('n_nationkey', 'int', 'nation'), ('n_name', 'string', 'nation'), ('n_regionkey', 'int', 'nation')) t(col_name, data_type, \"table\"), lateral (select case \"table\" when 'added' then 2 * (select count(*) from region) else (select count(*) from nation) end as n, false as has_region)",
    "deletion_everywhere": f"{_G}, {CATALOGUE.strip()}, {SECTIONS.strip()}"
    + """, gone as (select id from cat where process_status = 'extract_failed'), lost as (select id from nodes where document_id in (from gone)), w as (select doc_id, section_id from b group by all)
select 'documents' as kept_in, count(*) as n from cat where id not in (from gone) union all select 'edges', count(*) from edges where src not in (from lost) and dst not in (from lost) union all select 'nodes', count(*) from nodes where id not in (from lost)
union all select 'search', (select count(*) from b where doc_id not in (from gone)) + (select count(*) from w where doc_id not in (from gone)) union all select 'sections', count(*) from s where doc_id not in (from gone)
union all select 'tables', count(*) from b where type = 'table' and doc_id not in (from gone) union all select 'vectors', count(*) from embeddings where vec_id % 40 not in (from gone)""",
    "deletion_outcomes": "select doc_id as id, count(*) filter ((doc_id + k) * k % 5 < 3) as done, count(*) filter ((doc_id + k) * k % 5 < 3) >= 4 as success from documents, range(7) r(k) group by doc_id",
    "figure_rows": f"with {_FIG} select section_id, elem_id, image_path, caption, page, round(x1 / 595, 4) as x1, round(y1 / 842, 4) as y1, round(x2 / 595, 4) as x2, round(y2 / 842, 4) as y2, section_id[1:20] || '_page' || lpad(cast(page as varchar), 3, '0') || '_img' || lpad(regexp_extract(elem_id, '([0-9]+)$', 1), cast(greatest(2, length(regexp_extract(elem_id, '([0-9]+)$', 1))) as int), '0') || '_0.jpg' as renamed from fg",
    "figure_files": f"with {_FIG} select distinct doc_id, image_path from fg where doc_id > 3",
    "table_markup": """select page_id, case page_id % 3 when 0 then '<p>x</p><table id="a" class="multimodal-table old"><tr><th>a</th><td>b</td></tr></table><table class="b">' || url when 1 then '<table class="multimodal-table"><tr><td>' || url || '</td></tr></table>' else '<table class="multimodal-table"><tr><td>' || url || '</td></tr></table>' end as html,
cast(case page_id % 3 when 0 then 2 else 1 end as int) as n_cols from pages""",
    "table_row_texts": "select c_custkey, 'name: ' || c_name || case when c_mktsegment <> '' then ' | segment: ' || c_mktsegment else '' end as row_text from customer",
    "json_documents": "select doc_id, md5(text) as text_md5, lang from documents",
    "json_paths": "select doc_id as id, case doc_id % 4 when 0 then 'name_doc_' || doc_id || '.json' when 1 then doc_id || '.json' when 2 then 'doc_' || doc_id || '.json' end as name from documents",
    "decoded_texts": "select doc_id, md5(case when doc_id % 2 = 0 then text else '测试' end) as text_md5 from documents",
    "stale_files": "select count(*) as stale, max(event_id) as last_id from events where ts < timestamp '2024-01-18'",
    "timeouts": "select p_partkey, cast(case p_size % 4 when 0 then p_size when 1 then floor((p_size + 0.5) * 60) when 2 then p_size * 3600 else 60 end as int) as seconds from part",
    "lexicon_terms": """with e as (select p_partkey as ord, p_type as canonical, case when p_size % 2 = 0 then 'Protein' else 'Other' end as type, p_brand as b from part),
t as (select ord, 0 as a, lower(canonical) as term, canonical, type from e union all select ord, 1, lower(b), canonical, type from e union all select ord, 2, lower(b || '－１'), canonical, type from e union all select ord, 2, lower(b || '-1'), canonical, type from e)
select term, arg_max(canonical, (ord, a)) as canonical, arg_max(type, (ord, a)) as type, cast(case arg_max(type, (ord, a)) when 'Protein' then 2 else 99 end as int) as priority from t where term <> '' group by term""",
    "page_uploads": "select doc_id, n_chars * 40000 <= 104857600 and (doc_id % 4 in (0, 2) or lower(source) in ('pdf', 'md')) as taken, n_chars * 40000 <= 104857600 and doc_id % 4 in (0, 1, 2) as allowed from documents",
    "inline_references": """select page_id, 'see ' || case when contains(url, ']') then '[图片:' || url || ']' else '<span class="inline-reference image-ref" data-element-id="' || url || '">🖼️ ' || url || '</span>' end || ' and <span class="inline-reference table-ref" data-element-id="t' || page_id || '">📊 t' || page_id || '</span>, not [图:x] [图表:]' as text from pages""",
    "nation_tables": """select r_regionkey, coalesce('<table class="multimodal-table"><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' order by n_nationkey) || '</tbody></table>', '') as html from region left join nation on n_regionkey = r_regionkey group by r_regionkey""",
    "files_in_process": f"with {CATALOGUE} select process_status in ('pending', 'extracting', 'vectorizing', 'graph_processing') as in_process, count(*) as n from cat group by 1",
    "valid_queries": "select doc_id, doc_id % 9 <> 0 and length(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) between 1 and 1000 as valid from documents",
    "status_codes": f"select * from (values {_STATES}) t(status, progress, stage, label)",
    "ingestion_states": "with t as (select *, len(list_filter(regexp_extract_all(lower(text), '\\p{Han}|(?:[^\\P{L}\\p{Han}]|\\p{N})+'), lambda x: x not in (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))) as n from documents) select case when regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') = '' then 'extract_failed' when n_chars > 5000 then 'vectorize_failed' when n <= 3 then 'bm25_failed' when lang = 'es' then 'graph_failed' else 'completed' end as status, count(*) as n from t group by 1",
    "section_references": f"""with {SECTIONS}, h as (select doc_id % 10 as query_id, 'doc_' || doc_id as doc_name, title, page_start as page, doc_id * 10 + section_no as arrival, case when n_blocks > 3 then '表格' when n_blocks > 2 then '图片' end as media from s),
k as (select query_id, doc_name, media, count(*) as n, min(arrival) as first from h where media is not null group by all), ks as (select query_id, doc_name, string_agg(n || '个' || media, ', ' order by first) as kinds from k group by all),
g as (select query_id, doc_name, arg_min(title, arrival) as title, array_to_string(list_sort(list(distinct page)), ', ') as pages, min(arrival) as first from h group by all),
o as (select *, row_number() over (partition by query_id order by first) as number from g)
select query_id, cast(number as int) as number, '[' || number || '] ' || doc_name || case when title <> '' and title <> doc_name then ' - ' || title else '' end || ' 第' || pages || '页' || coalesce(' (包含' || kinds || ')', '') as line from o left join ks using (query_id, doc_name)""",
}
