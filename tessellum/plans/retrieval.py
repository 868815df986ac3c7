"""Queries on retrieval: BM25, vectors, intent, fusion, reranking and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as X
from tessellum.operators import retrieval as Q
from tessellum.operators import structure as S
from tessellum.operators import vector_index as V
from tessellum.plans.sql import ENCODED, SECTIONS
from tessellum.sources.fixtures import benchmark_queries, table, text_elements, vector_rows
from tessellum.sources.scratch import file_state, fresh_path

N_DOCS = 200


def _queries(spark, sf_dir):
    return benchmark_queries(table(spark, sf_dir, "benchmark"))


def _made_docs(spark, sf_dir):
    """Search documents with the kind of their file."""
    docs = table(spark, sf_dir, "documents")
    kinds = docs.select("doc_id", F.col("lang").alias("doc_type"))
    return S.search_documents(S.blocks(text_elements(docs))).join(kinds, "doc_id")


_stored: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir) -> Q.Index:
    """The stored index of the documents, made once for each state of their files."""
    key = spark.sparkContext.applicationId, file_state(spark, f"{sf_dir}/documents.parquet")
    if key not in _stored:
        path = fresh_path(spark, "index")
        Q.add_documents(_made_docs(spark, sf_dir), path)
        _stored[key] = path
    return Q.opened(spark, _stored[key])


def _vectors(spark, sf_dir):
    return vector_rows(table(spark, sf_dir, "embeddings"), N_DOCS)


def _query_vectors(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def posting_statistics(spark, sf_dir):
    made = _index(spark, sf_dir)
    top = made.frequencies.groupBy("field").agg(F.count("*").alias("terms"), F.max("df").alias("max_df"))
    return top.join(made.statistics, "field").select("field", "terms", "max_df", "n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf_dir):
    return Q.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), 10).select("query_id", "_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk_filtered(spark, sf_dir):
    return Q.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), 5, content_types=["section"]).select("query_id", "_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk_doc_types(spark, sf_dir):
    return Q.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), 5, doc_types=["fr", "de"], content_types=["fragment"]).select("query_id", "_id", F.round("score", 6).alias("score"), "rank")


def index_after_deletion(spark, sf_dir):
    """The best documents of the index once all documents of files that failed are deleted from it."""
    failed = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    path = fresh_path(spark, "index")
    Q.add_documents(_made_docs(spark, sf_dir), path)
    left = Q.delete_documents(Q.opened(spark, path), failed, path)
    return Q.bm25(_queries(spark, sf_dir), left, 3).select("query_id", "_id", F.round("score", 6).alias("score"), "rank")


def vector_topk(spark, sf_dir):
    return Q.vector_top(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark, sf_dir):
    return Q.vector_top(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 5, F.col("content_type").isin("title", "section")).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _vector_index(spark, sf_dir):
    return V.build(_vectors(spark, sf_dir), fresh_path(spark, "vectors"), nlist=64)


def vector_topk_probed(spark, sf_dir):
    """The stored index of all vectors; the fixtures' vectors have no clusters, so many cells' lists are read. Tests measure recall."""
    found = V.search(_vector_index(spark, sf_dir), _query_vectors(spark, sf_dir), 10, nprobe=40, refine=120)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vector_index_members(spark, sf_dir):
    """How often each vector stands in the lists of the stored index."""
    return _vector_index(spark, sf_dir).lists().select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def vector_intent(spark, sf_dir):
    rows = Q.intent(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir))
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("max_title", "mean_title", "max_fragment", "mean_fragment")], "intent")


def fallback_intent(spark, sf_dir):
    return Q.fallback_intent(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir)).select("query_id", F.round("lead", 6).alias("lead"), "intent")


def vector_statistics(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("content_type").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def vectors_without_document(spark, sf_dir):
    return _vectors(spark, sf_dir).filter(F.col("document_id") != 7).groupBy("content_type").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def _hits(spark, sf_dir, intent="fragment"):
    """Hits of the lexical and the vector branch: vectors stand for sections of their documents."""
    made = _index(spark, sf_dir)
    docs = made.docs
    lexical = Q.bm25(_queries(spark, sf_dir), made, Q.BREADTH[intent]).join(docs, "_id").withColumn("source", F.lit("bm25")).withColumn("arrival", F.col("rank"))
    first = docs.filter("content_type = 'section'").groupBy(F.col("doc_id").alias("document_id")).agg(F.min("section_id").alias("section_id"))
    near = Q.vector_top(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), Q.BREADTH[intent]).join(_vectors(spark, sf_dir).drop("vector"), "id").join(first, "document_id")
    near = near.select("query_id", "section_id", F.col("document_id").alias("doc_id"), F.col("id").alias("element_id"), F.lit("").alias("title"), F.lit("").alias("content"), "content_type", F.lit(1).alias("page"), "score", F.lit("vector").alias("source"), (F.col("rank") + 1000).alias("arrival"))
    return lexical.select(near.columns).unionByName(near).withColumn("intent", F.lit(intent))


def score_fusion(spark, sf_dir):
    rows = Q.fuse(_hits(spark, sf_dir), most=10)
    return rows.select("query_id", "section_id", F.round("bm25_score", 5).alias("bm25_score"), F.round("vector_score", 5).alias("vector_score"), F.round("final_score", 5).alias("final_score"), "n_hits", F.array_join("sources", ",").alias("sources"), "rank")


def title_fusion(spark, sf_dir):
    rows = Q.fuse(_hits(spark, sf_dir, "title"), most=10)
    return rows.select("query_id", "section_id", F.round("final_score", 5).alias("final_score"), "has_title_match", "rank")


def lexical_rerank(spark, sf_dir):
    rows = Q.rerank(Q.fuse(_hits(spark, sf_dir)), _queries(spark, sf_dir))
    return rows.select("query_id", "section_id", "title", F.round("rerank_score", 5).alias("rerank_score"), F.round("final_score", 5).alias("final_score"))


def query_understanding(spark, sf_dir):
    q = F.col("query")
    return _queries(spark, sf_dir).select(
        "query_id", X.normalise_query(q).alias("normalised"), X.lexical_intent(q).alias("intent"), F.array_join(X.keywords(q), " ").alias("keywords"), X.vector_query(q, X.lexical_intent(q)).alias("vector_query"), F.to_json(X.query_entities(q)).alias("entities"),
    )


def query_keywords(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", F.array_join(X.keywords(F.col("query")), " ").alias("keywords"), F.round(X.title_similarity(F.col("query")), 6).alias("similarity"))


def suggestions(spark, sf_dir):
    """For the first word of each query: section titles that contain it, most frequent first."""
    titles = S.sections(S.blocks(text_elements(table(spark, sf_dir, "documents")))).groupBy("title").agg(F.count("*").alias("n")).withColumn("low", F.lower("title"))
    typed = _queries(spark, sf_dir).select("query_id", F.lower(F.split("query", " ")[0]).alias("typed"))
    hits = X.containing(titles, "low", typed.select("typed").distinct(), "typed").join(typed, "typed")
    return Q.top(hits, 10, F.desc("n"), F.asc("title")).select("query_id", "typed", "title", "n", "rank")


def highlights(spark, sf_dir):
    """The best document of each query: its title and the fragments of its content with the query's words marked."""
    made = _index(spark, sf_dir)
    hits = Q.bm25(_queries(spark, sf_dir), made, 1).join(made.docs, "_id").join(_queries(spark, sf_dir), "query_id")
    terms = F.array_distinct(X.tokens(F.col("query")))
    return hits.select("query_id", "_id", X.highlight_whole(F.col("title"), terms).alias("title"), F.array_join(X.highlight(F.col("content"), terms), " ... ").alias("highlight"))


def _titles(spark, sf_dir):
    titles = S.sections(S.blocks(text_elements(table(spark, sf_dir, "documents")))).select("section_id", "title")
    return titles.withColumn("vector", Q.encoder()(X.encoder_input(F.col("title"), marks=True, lower=True)))


def encoded_titles(spark, sf_dir):
    """Vectors of section titles, as the sum of each component times its place."""
    check = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.lit(64)), lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x)
    return _titles(spark, sf_dir).select("section_id", F.round(check, 6).alias("checksum"), F.size("vector").alias("dimension"))


def encoded_search(spark, sf_dir):
    """Section titles nearest to each query, both encoded; the query is rewritten by its intent first. Equal titles have equal scores, so titles are ranked."""
    q = F.col("query")
    asked = _queries(spark, sf_dir).filter(X.valid_query(q)).select("query_id", Q.encoder()(X.encoder_input(X.vector_query(q, X.lexical_intent(q)), marks=True, lower=True)).alias("query_vector"))
    titles = _titles(spark, sf_dir).groupBy("title").agg(F.min("section_id").alias("section_id"), F.first("vector").alias("vector")).withColumn("id", F.col("section_id"))
    return Q.vector_top(asked, titles, 5).select("query_id", F.col("id").alias("section_id"), F.round("score", 6).alias("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        posting_statistics, bm25_topk, bm25_topk_filtered, bm25_topk_doc_types, index_after_deletion, vector_topk, vector_topk_filtered, vector_topk_probed, vector_index_members, vector_intent, fallback_intent, vector_statistics, vectors_without_document, score_fusion, title_fusion, lexical_rerank,
        query_understanding, query_keywords, suggestions, highlights, encoded_titles, encoded_search,
    )
}

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '\\p{{Han}}|(?:[^\\P{{L}}\\p{{Han}}]|\\p{{N}})+'), lambda t: t not in ({_STOP}))"
_QUERY = """q as (select item_id as query_id, array_to_string(string_split(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')[1:5], ' ') as query from benchmark)"""
_DOCS = f"""{SECTIONS},
w as (select doc_id || '_section_' || section_id as _id, doc_id, section_id, section_id as element_id, title, string_agg(text, ' ' order by ord) as content, title as summary, 'section' as content_type, arg_min(page, ord) as page
  from b join s using (doc_id, section_no, section_id) group by doc_id, section_id, title),
d as (select * from w union all select b.doc_id || '_fragment_' || b.section_id || '_' || b.elem_id, b.doc_id, b.section_id, b.elem_id, s.title, b.text, case when length(b.text) > 200 then b.text[1:200] || '...' else b.text end, 'fragment', b.page from b join s using (section_id)),
f as (select _id, 'title' as field, {_TOK("title")} as toks from d union all select _id, 'content', {_TOK("content")} from d union all select _id, 'summary', {_TOK("summary")} from d),
p as (select field, _id, len(toks) as dl, term, count(*) as tf from (select field, _id, toks, unnest(toks) as term from f) group by all),
df as (select field, term, count(*) as df from p group by all),
st as (select field, count(*) as n, avg(len(toks)) as avgdl from f where len(toks) > 0 group by field)"""
_BM25 = f"""with {_DOCS}, {_QUERY},
kw as (select query_id, list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)[1:10] as ws from q),
c0 as (select query_id, 0 as clause, 2.0 as boost, unnest({_TOK("query")}) as term from q
  union all select query_id, clause, 1.5, unnest({_TOK("w")}) from (select query_id, unnest(ws) as w, generate_subscripts(ws, 1) as clause from kw)),
c as (select query_id, clause, cast(boost as double) as boost, term, count(*) as times from c0 group by all),
wt as (select p.field, p.term, p._id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as weight from p join df using (field, term) join st using (field) where p.term in (select term from c)),
bf as (select query_id, _id, clause, boost, field, sum(weight * times) as s from wt join c using (term) group by all),
bc as (select query_id, _id, clause, boost, max(s * case field when 'title' then 3 when 'summary' then 2 else case when clause = 0 then 1 else 1.5 end end) as s from bf group by all),
sc as (select query_id, _id, sum(s * boost) as score from bc group by all)"""
_VEC = """v as (select vec_id, cast(vec_id as varchar) as id, cast(embedding as double[]) as vector, vec_id % 200 as document_id, case when label <= 2 then 'title' when label <= 4 then 'section' else 'fragment' end as content_type from embeddings),
qv as (select vec_id as query_id, vector as query_vector from v where vec_id in (select item_id from benchmark)),
vs as (select query_id, id, vec_id, document_id, content_type, list_dot_product(vector, query_vector) / sqrt(list_dot_product(vector, vector) * list_dot_product(query_vector, query_vector)) as score from v, qv)"""
_RANKED = "row_number() over (partition by query_id order by round(score, 9) desc, vec_id)"


def _fused(intent: str) -> str:
    k = Q.BREADTH[intent]
    wb, wv = Q.WEIGHTS[intent]
    boost = "case when content_type = 'title' then 1.5 else 1 end" if intent == "title" else "1"
    return f"""{_BM25}, {_VEC},
lx as (select query_id, _id, score, row_number() over (partition by query_id order by round(score, 9) desc, _id) as rank from sc qualify rank <= {k}),
first as (select doc_id as document_id, min(section_id) as section_id from w group by doc_id),
h as (
  select query_id, section_id, title, content, content_type, score, 'bm25' as source, rank as arrival from lx join d using (_id)
  union all select query_id, section_id, '', '', content_type, score, 'vector', {_RANKED} + 1000 as arrival from vs join first using (document_id) qualify true),
h2 as (select query_id, section_id, title, content, content_type, score * {boost} as score, source, arrival, content_type = 'title' and '{intent}' = 'title' as on_title from h where source = 'bm25' or arrival <= 1000 + {k}),
g as (
  select query_id, section_id, coalesce(sum(score * score) filter (source = 'bm25') / nullif(sum(score) filter (source = 'bm25'), 0), 0) as bm25_score,
    coalesce(sum(score * score) filter (source = 'vector') / nullif(sum(score) filter (source = 'vector'), 0), 0) as vector_score, min(arrival) as arrival, count(*) as n_hits, array_to_string(list_sort(list(distinct source)), ',') as sources,
    bool_or(on_title) as has_title_match, arg_min(title, arrival) as title, arg_max(content, {{'s': score, 'a': -arrival}}) as evidence
  from h2 group by all),
r as (select *, {wb} * bm25_score + {wv} * vector_score as final_score, row_number() over (partition by query_id order by round({wb} * bm25_score + {wv} * vector_score, 9) desc, arrival) as rank from g)"""


#: A text as encoders take it, and the hashed vectors (key, vector) of a table's texts.
_INPUT = lambda c: f"regexp_replace(lower(regexp_replace(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_ 一-鿿]', '', 'g'))[1:512], '^ +| +$', '', 'g')"


_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"

_KEYWORDS = f"""select query_id, array_to_string(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)[1:10], ' ') as keywords,
  round(least(len(list_intersect(ws, tw)) / len(list_distinct(list_concat(ws, tw))) + case when length(query) <= 5 then 0.1 when length(query) > 20 then -0.1 else 0 end, 1.0), 6) as similarity from (select query_id, query, list_distinct(list_filter(string_split(query, ' '), lambda x: x <> '')) as ws, {X.TITLE_WORDS!r} as tw from q)"""


def _understanding() -> str:
    """Normalisation step by step, as the fixture has no characters that NFKC changes beyond NFC."""
    out = "translate(regexp_replace(regexp_replace(nfc_normalize(query), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '，。；', ',.;')"
    for key, value in X.SYNONYMS.items():
        for old, new in [(key, value)] if isinstance(value, str) else [(v, key) for v in value]:
            out = f"replace({out}, '{old}', '{new}')"
    low = ", ".join(f"'{w}'" for w in X.LOW_INFORMATION)
    names = {kind: "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(query, '(?i){p}')" for p in ps) + ")))" for kind, ps in X.QUERY_ENTITIES.items()}
    none = " and ".join(f"len({n}) = 0" for n in names.values())
    found = ", ".join(f"'{kind}': {n}" for kind, n in names.items())
    return f"""with {_QUERY}, k as ({_KEYWORDS}),
i as (select query_id, keywords, case when similarity >= 0.45 then 'title' when similarity >= 0.40 then 'hybrid' else 'fragment' end as intent from k),
o as (select query_id, query, {out} as whole from q), p as (select *, list_filter(string_split(whole, ' '), lambda w: w <> '' and w not in ({low})) as kept from o)
select query_id, case when len(kept) > 0 then array_to_string(kept, ' ') else whole end as normalised, intent, keywords,
  query || case intent when 'title' then {X.VECTOR_SUFFIX["title"]!r} when 'fragment' then {X.VECTOR_SUFFIX["fragment"]!r} else '' end as vector_query,
  cast(to_json({{{found}, 'general': case when {none} then [query] else [] end}}) as varchar) as entities
from p join i using (query_id)"""


ORACLES = {
    "vector_index_members": "select cast(vec_id as varchar) as id, count(*) as n from embeddings group by vec_id",
    "query_understanding": _understanding(),
    "posting_statistics": f"with {_DOCS} select field, count(*) as terms, max(df) as max_df, any_value(n) as n, round(any_value(avgdl), 6) as avgdl from df join st using (field) group by field",
    "bm25_topk": _BM25 + " select query_id, _id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, _id) as int) as rank from sc qualify rank <= 10",
    "bm25_topk_filtered": _BM25 + " select query_id, _id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, _id) as int) as rank from sc where _id in (select _id from d where content_type = 'section') qualify rank <= 5",
    "vector_topk": f"with {_VEC} select query_id, id, round(score, 6) as score, cast({_RANKED} as int) as rank from vs qualify rank <= 10",
    "vector_topk_filtered": f"with {_VEC} select query_id, id, round(score, 6) as score, cast({_RANKED} as int) as rank from vs where content_type <> 'fragment' qualify rank <= 5",
    "vector_intent": f"""with {_VEC}, r as (select *, row_number() over (partition by query_id, content_type = 'fragment' order by round(score, 9) desc, vec_id) as rank from vs qualify rank <= 5),
m as (select query_id, coalesce(max(score) filter (content_type <> 'fragment'), 0) as max_title, coalesce(avg(score) filter (content_type <> 'fragment'), 0) as mean_title, coalesce(max(score) filter (content_type = 'fragment'), 0) as max_fragment, coalesce(avg(score) filter (content_type = 'fragment'), 0) as mean_fragment from r group by query_id)
select query_id, round(max_title, 6) as max_title, round(mean_title, 6) as mean_title, round(max_fragment, 6) as max_fragment, round(mean_fragment, 6) as mean_fragment,
  case when max_title - max_fragment > 0.1 and mean_title - mean_fragment > 0.05 then 'title' when max_title - max_fragment < -0.1 and mean_title - mean_fragment < -0.05 then 'fragment' when abs(max_title - max_fragment) <= 0.05 then 'hybrid' when max_title > max_fragment then 'title' else 'fragment' end as intent from m""",
    "fallback_intent": f"with {_VEC}, r as (select *, {_RANKED} as rank from vs qualify rank <= 20), m as (select query_id, coalesce(max(score) filter (content_type = 'title'), 0) - coalesce(max(score) filter (content_type <> 'title'), 0) as lead from r group by query_id) select query_id, round(lead, 6) as lead, case when lead > 0.1 then 'title' when lead < -0.1 then 'fragment' end as intent from m",
    "vector_statistics": f"with {_VEC} select content_type, count(*) as n, count(distinct document_id) as documents from v group by content_type",
    "vectors_without_document": f"with {_VEC} select content_type, count(*) as n, cast(sum(vec_id) as bigint) as ids from v where document_id <> 7 group by content_type",
    "score_fusion": _fused("fragment") + " select query_id, section_id, round(bm25_score, 5) as bm25_score, round(vector_score, 5) as vector_score, round(final_score, 5) as final_score, n_hits, sources, cast(rank as int) as rank from r where rank <= 10",
    "title_fusion": _fused("title") + " select query_id, section_id, round(final_score, 5) as final_score, has_title_match, cast(rank as int) as rank from r where rank <= 10",
    "lexical_rerank": _fused("fragment")
    + f""", m as (select r.*, q.query, len(list_intersect({_WORDS("q.query")}, {_WORDS("r.title")})) / len({_WORDS("q.query")}) as tm, len(list_intersect({_WORDS("q.query")}, {_WORDS("r.evidence")})) / len({_WORDS("q.query")}) as em from r join q using (query_id) where rank <= 50)
select query_id, section_id, title, round(tm * 1.5 + em, 5) as rerank_score, round(final_score * 0.5 + (tm * 1.5 + em) * 0.5, 5) as final_score from m qualify row_number() over (partition by query_id order by round(final_score * 0.5 + (tm * 1.5 + em) * 0.5, 9) desc, arrival) = 1""",
    "query_keywords": f"with {_QUERY} {_KEYWORDS}",
    "suggestions": f"""with {SECTIONS}, {_QUERY}, t as (select title, count(*) as n from s group by title), u as (select query_id, lower(string_split(query, ' ')[1]) as typed from q)
select query_id, typed, title, n, cast(row_number() over (partition by query_id order by n desc, title) as int) as rank from t join u on typed <> '' and contains(lower(title), typed) qualify rank <= 10""",
    "bm25_topk_doc_types": _BM25 + ", ok as (select _id from d join documents using (doc_id) where content_type = 'fragment' and lang in ('fr', 'de')) select query_id, _id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, _id) as int) as rank from sc where _id in (from ok) qualify rank <= 5",
    "index_after_deletion": _BM25.replace("\nd as (", "\nd0 as (").replace("\nf as (", "\nd as (select * from d0 where doc_id not in (select doc_id from labels where quality = 0)),\nf as (")
    + " select query_id, _id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, _id) as int) as rank from sc qualify rank <= 3",
    "encoded_titles": f"""with {SECTIONS}, {ENCODED("t", "s", "section_id", _INPUT("title"))}
select section_id, round(list_dot_product(vector, list_transform(range(1, 65), lambda i: cast(i as double))), 6) as checksum, 64 as dimension from t""",
    "encoded_search": f"""with {SECTIONS}, {_QUERY}, kw as ({_KEYWORDS}), qs as (select query_id, query || case when similarity >= 0.45 then {X.VECTOR_SUFFIX["title"]!r} when similarity >= 0.40 then '' else {X.VECTOR_SUFFIX["fragment"]!r} end as text from kw join q using (query_id)),
{ENCODED("a", "qs", "query_id", _INPUT("text"))}, st as (select title, min(section_id) as section_id from s group by title), {ENCODED("t", "st", "section_id", _INPUT("title"))},
sc as (select query_id, t.section_id, list_dot_product(a.vector, t.vector) as score from a, t)
select query_id, section_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, section_id) as int) as rank from sc qualify rank <= 5""",
}
