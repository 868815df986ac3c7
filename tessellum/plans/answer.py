"""Queries on answers, streams, sessions and the front end's data operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.operators import answer as A
from tessellum.operators import retrieval as Q
from tessellum.operators import structure as S
from tessellum.plans.retrieval import _hits, _queries
from tessellum.plans.sql import SECTIONS
from tessellum.sources.fixtures import status_events, table, text_elements
from tessellum.sources.scratch import fresh_path
from tessellum.streaming import ingestion, keyed
from tessellum.streaming.status import latest_status


def _media(spark, sf_dir):
    blocks = S.blocks(text_elements(table(spark, sf_dir, "documents")))
    parts = S.sections(blocks)
    return parts, A.media_of_sections(parts, S.figure_rows(blocks), S.table_heads(blocks), S.table_lines(blocks))


def section_media(spark, sf_dir):
    return _media(spark, sf_dir)[1].select("section_id", "order", "content_type", "elem_id", "content", "n_rows")


def section_expansion(spark, sf_dir):
    """All sections; documents without entities of their own take those that the words of their titles name."""
    parts, media = _media(spark, sf_dir)
    contains = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("document"), F.concat(F.lit("e"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("id"))
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    return A.expansion(parts, media, contains, 5, names, 3)


def table_views(spark, sf_dir):
    return A.table_view(_media(spark, sf_dir)[1])


def search_answers(spark, sf_dir):
    """The whole search: recall, fusion, reranking, enrichment and rendering of every query, as ordered events."""
    chosen = Q.rerank(Q.fuse(_hits(spark, sf_dir)), _queries(spark, sf_dir)).withColumn("doc_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return A.render(chosen, _media(spark, sf_dir)[1])


def table_cells(spark, sf_dir):
    lines = S.table_lines(S.blocks(text_elements(table(spark, sf_dir, "documents"))))
    return lines.select("table_elem_id", F.size(A.cells(F.col("row_text"))).alias("n_cells"), F.array_join(A.headers(F.col("row_text"), F.lit(None).cast("string")), ";").alias("headers"))


def status_latest(spark, sf_dir):
    return latest_status(status_events(table(spark, sf_dir, "events")))


def session_answers(spark, sf_dir):
    """Results of each user's search, users' events as results in order: what a caller that doesn't listen to the stream is given."""
    kind = F.when(F.col("event_type") == "purchase", "final_answer").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "stage_update").otherwise("answer_chunk")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    results = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), seq.alias("seq"), kind.alias("type"), F.to_json(F.struct("event_id")).alias("payload"))
    return keyed.answers(results)


def ingested_files(spark, sf_dir):
    """Documents through the stages that make structure and rows of tables: the state of each, its sections and its blocks."""
    stages = [s for s in ingestion.file_stages([]) if s.name in ("structure", "tables")]
    store = ingestion.Ingested(spark, fresh_path(spark, "ingested"), stages)
    store.ingest(table(spark, sf_dir, "documents"), 0)
    sections = store.table("sections", "tables").groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("n_blocks").alias("n_blocks"))
    return store.states().join(sections, "doc_id", "left").select("doc_id", "status", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def session_list(spark, sf_dir):
    """Conversations by their last turn: count, and a title of 30 characters at most."""
    turns = table(spark, sf_dir, "conversations")
    title = F.min_by("text", "turn")
    rows = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"), title.alias("t"))
    return rows.select("conv_id", "last_turn", "messages", F.when(F.length("t") > 30, F.concat(F.substring("t", 1, 30), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def relative_times(spark, sf_dir):
    minutes = F.floor((F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")) / 60)
    bucket = F.when(minutes < 1, "now").when(minutes < 60, "minutes").when(minutes < 1440, "hours").when(minutes < 10080, "days").otherwise("date")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def changed_messages(spark, sf_dir):
    """Messages of one list that the other lacks, by hash."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    return turns.filter("turn % 2 = 0").select("h").exceptAll(turns.filter("turn % 2 = 1").select("h")).agg(F.count("*").alias("changed"))


QUERIES = {f.__name__: f for f in (section_media, section_expansion, table_views, search_answers, table_cells, status_latest, session_answers, ingested_files, session_list, relative_times, changed_messages)}

_MEDIA = f"""with {SECTIONS}, media as (select section_id, cast(row_number() over (partition by section_id order by section_id || '_' || elem_id) as int) as ord, 'table' as content_type, section_id || '_' || elem_id as elem_id, text as content, 1 as n_rows from b where type = 'table')"""

ORACLES = {
    "section_media": _MEDIA + ' select section_id, ord as "order", content_type, elem_id, content, n_rows from media',
    "section_expansion": _MEDIA
    + """, own as (select * from s), ent as (select vec_id % 50 as doc_id, 'e' || lpad(cast(vec_id as varchar), 5, '0') as id, row_number() over (partition by vec_id % 50 order by vec_id) as k from embeddings qualify k <= 5),
lone as (select section_id, list_filter(regexp_extract_all(title, '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)[1:10] as ws from own where doc_id not in (select doc_id from ent)),
ask as (select section_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from lone),
hit as (select word, 'b' || item_id as id from (select distinct word from ask) join benchmark on contains(text, word) qualify row_number() over (partition by word order by 'b' || item_id) <= 3),
fall as (select section_id, id, row_number() over (partition by section_id order by min(k), id) as k from ask join hit using (word) group by section_id, id),
x as (select section_id, 0 as rank, 0 as k, 'title' as kind, title as element_id from own union all select section_id, 1, media.ord, content_type, elem_id from media join own using (section_id) union all select section_id, 2, k, 'entity', id from ent join own using (doc_id) union all select section_id, 2, k, 'entity', id from fall)
select section_id, cast(row_number() over (partition by section_id order by rank, k) as int) as "order", kind, element_id from x""",
    "table_views": _MEDIA + " select section_id, elem_id, n_rows, false as enable_search, false as pagination, '/api/table/export/' || elem_id || '/csv' as export_csv_url, '/api/file/view/' || regexp_extract(section_id, '#([0-9]+)_[^#]*$', 1) || '?highlight=table' as view_url from media",
    "table_cells": f"with {SECTIONS}, c as (select section_id || '_' || elem_id as table_elem_id, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x, ' ')), lambda x: x <> '') as cs from b where type = 'table') select table_elem_id, cast(len(cs) as int) as n_cells, array_to_string(cs, ';') as headers from c",
    "session_answers": "with r as (select user_id as query_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, case event_type when 'purchase' then 'final_answer' when 'error' then 'error' when 'view' then 'stage_update' else 'answer_chunk' end as type, '{\"event_id\":' || event_id || '}' as payload from events), a as (select query_id, arg_max(payload, seq) filter (type = 'final_answer') as answer, count(*) as chunks, count(*) filter (type = 'error') as errors from r group by 1) select query_id, answer is not null or errors = 0 as success, coalesce(answer, '{}') as answer, chunks from a",
    "ingested_files": f"with {SECTIONS}, n as (select doc_id, count(*) as n_sections, sum(n_blocks) as n_blocks from s group by 1) select doc_id, case when n_sections is null then 'extract_failed' else 'completed' end as status, coalesce(n_sections, 0) as n_sections, cast(coalesce(n_blocks, 0) as bigint) as n_blocks from documents left join n using (doc_id)",
    "status_latest": "with e as (select user_id as file_id, case event_type when 'purchase' then 'completed' when 'error' then 'extract_failed' when 'signup' then 'pending' when 'view' then 'extracting' else 'vectorizing' end as status, ts, event_id from events) select file_id, arg_max(status, (ts, event_id)) as status, max(ts) as updated_at, count(*) as events, case arg_max(status, (ts, event_id)) when 'completed' then 100 when 'extract_failed' then 40 when 'pending' then 10 when 'extracting' then 25 else 50 end as progress from e group by file_id",
    "session_list": "select conv_id, max(turn) as last_turn, count(*) as messages, case when length(arg_min(text, turn)) > 30 then arg_min(text, turn)[1:30] || '...' else arg_min(text, turn) end as title from conversations group by conv_id",
    "relative_times": "with m as (select floor((epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 60) as n from events) select case when n < 1 then 'now' when n < 60 then 'minutes' when n < 1440 then 'hours' when n < 10080 then 'days' else 'date' end as bucket, count(*) as n from m group by 1",
    "changed_messages": "select count(*) as changed from (select md5(text) from conversations where turn % 2 = 0 except all select md5(text) from conversations where turn % 2 = 1)",
}
