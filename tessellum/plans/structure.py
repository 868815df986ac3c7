"""Queries on sections, blocks, units and relational rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import structure as S
from tessellum.plans.sql import BLOCKS, SECTIONS
from tessellum.sources.files import partition_files
from tessellum.sources.fixtures import html_elements, table, text_elements


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(text_elements(table(spark, sf_dir, "documents")))


def elements(spark, sf_dir):
    return text_elements(table(spark, sf_dir, "documents"))


def page_elements(spark, sf_dir):
    return html_elements(table(spark, sf_dir, "pages"))


def partitioned_files(spark, sf_dir):
    """Elements of files by their kinds: pages as HTML, documents as plain text, and bytes of a kind without a model."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), "page_id", F.lit(".HTML")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".pdf")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return partition_files(pages.union(docs))


def blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "section_id", "order", "elem_id", "type", "page", "text")


def sections(spark, sf_dir):
    return S.sections(_blocks(spark, sf_dir)).drop("section_no")


def content_units(spark, sf_dir):
    return S.content_units(_blocks(spark, sf_dir))


def search_documents(spark, sf_dir):
    return S.search_documents(_blocks(spark, sf_dir))


def search_documents_colliding(spark, sf_dir):
    return S.search_documents(_blocks(spark, sf_dir), collide=True)


def text_offsets(spark, sf_dir):
    return S.text_offsets(_blocks(spark, sf_dir)).select("doc_id", "section_id", "elem_id", "page", "start", "end")


def section_rows(spark, sf_dir):
    return S.sections(_blocks(spark, sf_dir)).select("section_id", "doc_id", F.lit(1).alias("version"), "title", "page_start", "page_end")


def table_heads(spark, sf_dir):
    return S.table_heads(_blocks(spark, sf_dir))


def table_lines(spark, sf_dir):
    return S.table_lines(_blocks(spark, sf_dir))


def text_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.chunks(F.col("text"))).alias("chunk_no", "chunk")).filter("chunk <> ''")


def document_json(spark, sf_dir):
    """One nested document for each file: its sections with their blocks, as JSON."""
    block = F.struct("order", "elem_id", "type", "page", "text")
    parts = _blocks(spark, sf_dir).groupBy("doc_id", "section_no", "section_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    section = F.struct("section_no", "section_id", "blocks")
    return parts.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("total_sections"), F.array_sort(F.collect_list(section)).alias("sections"))).alias("document"), F.count("*").alias("total_sections"))


QUERIES = {f.__name__: f for f in (elements, page_elements, partitioned_files, blocks, sections, content_units, search_documents, search_documents_colliding, text_offsets, section_rows, table_heads, table_lines, text_chunks, document_json)}

_UNITS = f"""with {SECTIONS},
u as (
  select doc_id, section_no, 0 as rank, 0 as ord, section_id as element_id, section_id, title, title as content, 'title' as content_type, page_start as page from s
  union all select doc_id, section_no, 1, 0, section_id || '_full', section_id, title, full_text, 'section', page_start from s where full_text <> title
  union all select b.doc_id, b.section_no, 2, b.ord, b.elem_id, b.section_id, s.title, b.text, 'fragment', b.page from b join s using (section_id) where b.type <> 'title'),
n as (select *, cast(row_number() over (partition by doc_id order by section_no, rank, ord) - 1 as int) as chunk_index from u)
"""
_SEARCH = f"""with {SECTIONS},
w as (select doc_id || '_section_' || section_id as _id, doc_id, section_id, section_id as element_id, title, string_agg(text, ' ' order by ord) as content, title as summary, 'section' as content_type, arg_min(page, ord) as page
  from b join s using (doc_id, section_no, section_id) group by doc_id, section_id, title),
f as (select b.doc_id, b.section_no, b.section_id, b.elem_id, s.title, b.text as content, case when length(b.text) > 200 then b.text[1:200] || '...' else b.text end as summary, b.page from b join s using (section_id))
"""

_PAGES = r"""with f as (select page_id, regexp_extract_all(html, '(?is)<(?:h1|li|p)\b[^>]*>.*?</(?:h1|li|p)>') as found from pages),
r as (select page_id, unnest(found) as raw, cast(generate_subscripts(found, 1) - 1 as int) as elem_index from f),
t as (select *, lower(regexp_extract(raw, '^<([a-zA-Z0-9]+)', 1)) as tag from r),
x as (select page_id, elem_index, tag, case tag when 'h1' then regexp_extract(raw, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) when 'li' then regexp_extract(raw, '(?is)<li\b[^>]*>(.*?)</li>', 1) else regexp_extract(raw, '(?is)<p\b[^>]*>(.*?)</p>', 1) end as inner_html from t)
select page_id, elem_index, case tag when 'h1' then 'Title' when 'li' then 'ListItem' else 'NarrativeText' end as elem_type, trim(regexp_replace(regexp_replace(inner_html, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') as text
from x where trim(regexp_replace(regexp_replace(inner_html, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') <> ''"""

ORACLES = {
    "page_elements": _PAGES,
    "partitioned_files": f"with {BLOCKS}, g as ({_PAGES}) select 'd/' || doc_id || '.txt' as path, cast(elem_index as int) as elem_index, elem_type, text, page from el where doc_id % 2 = 0 union all select 'p/' || page_id || '.HTML', elem_index, elem_type, text, 1 from g",
    "document_json": f"""with {SECTIONS}, parts as (select doc_id, section_no, section_id, list({{'order': ord, 'elem_id': elem_id, 'type': type, 'page': page, 'text': text}} order by ord) as blocks from b group by all)
select doc_id, cast(to_json({{'total_sections': count(*), 'sections': list({{'section_no': section_no, 'section_id': section_id, 'blocks': blocks}} order by section_no)}}) as varchar) as document, count(*) as total_sections from parts group by doc_id""",
    "elements": f"with {BLOCKS} select doc_id, cast(elem_index as int) as elem_index, elem_type, l.line as text, page from (select doc_id, elem_index, elem_type, page from el) join (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as elem_index from documents) l using (doc_id, elem_index)",
    "blocks": f'with {BLOCKS} select doc_id, section_id, ord as "order", elem_id, type, page, text from b',
    "sections": f"with {SECTIONS} select doc_id, section_id, title, page_start, page_end, full_text, n_blocks from s",
    "content_units": _UNITS + "select doc_id || '_' || chunk_index as id, doc_id, chunk_index, element_id, section_id, title, content, content_type, page from n",
    "search_documents": _SEARCH + "select * from w union all select doc_id || '_fragment_' || section_id || '_' || elem_id, doc_id, section_id, elem_id, title, content, summary, 'fragment', page from f",
    "search_documents_colliding": _SEARCH + "select * from w union all select doc_id || '_fragment_' || elem_id, doc_id, section_id, elem_id, title, content, summary, 'fragment', page from f qualify row_number() over (partition by doc_id, elem_id order by section_no desc) = 1",
    "text_offsets": f"with {BLOCKS}, o as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by elem_index rows between unbounded preceding and 1 preceding), 0) as start from b) select doc_id, section_id, elem_id, page, cast(start as bigint) as start, cast(start + length(text) as bigint) as \"end\" from o",
    "section_rows": f"with {SECTIONS} select section_id, doc_id, 1 as version, title, page_start, page_end from s",
    "table_heads": f"with {BLOCKS} select doc_id, section_id || '_' || elem_id as elem_id, section_id, '<table class=\"multimodal-table\"><tr><td>' || text || '</td></tr></table>' as table_html, 1 as n_rows, 2 as n_cols, 1 as n_cols_html from b where type = 'table'",
    "table_lines": f"with {BLOCKS} select section_id, section_id || '_' || elem_id as table_elem_id, 0 as row_index, text as row_text, '{{\"row_id\":\"' || elem_id || '_r1\",\"row_text\":' || cast(to_json(text) as varchar) || '}}' as row_json from b where type = 'table'",
    "text_chunks": "with c as (select doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) as i from documents where text is not null) select doc_id, cast(i / 800 as int) as chunk_no, text[i + 1 : i + 1000] as chunk from c where text[i + 1 : i + 1000] <> ''",
}
