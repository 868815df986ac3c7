"""From a chosen section to an answer: media, expansion, rendering and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions.text import containing, keywords

#: Labels of kinds of media in references.
MEDIA = {"image": "图片", "table": "表格", "chart": "图表"}


def document_of(section_id: Column) -> Column:
    """The document's number within a section id like `x_doc#date#7_0009`."""
    return F.nullif(F.regexp_extract(section_id, r"#(\d+)_[^#]*$", 1), F.lit("")).cast("long")


def image_url(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(F.startswith(path, F.lit("http")) | F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/static/uploads/"), path))


def cells(row_text: Column) -> Column:
    return F.filter(F.transform(F.split(row_text, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def headers(first_row: Column, html: Column) -> Column:
    """Cells of the first row, or the th cells of the HTML."""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), lambda c: F.trim(c))
    return F.when(F.coalesce(F.size(cells(first_row)), F.lit(0)) > 0, cells(first_row)).otherwise(found)


def marked(content: Column, element_id: Column, chosen: Column) -> Column:
    return F.when(F.array_contains(chosen, element_id), F.concat(F.lit("<mark>"), content, F.lit("</mark>"))).otherwise(content)


def media_of_sections(sections: DataFrame, figures: DataFrame, tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Figures, then tables with their rows, of the sections (section_id), in one order for each."""
    wanted = sections.select("section_id").distinct()
    f = figures.join(wanted, "section_id", "left_semi").select("section_id", F.lit("image").alias("content_type"), F.col("page").alias("major"), "elem_id", F.col("caption").alias("content"), image_url(F.col("image_path")).alias("url"), F.lit(0).alias("n_rows"))
    rows = lines.groupBy("table_elem_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_text"))), lambda r: r["row_text"]), "\n").alias("content"))
    t = tables.join(wanted, "section_id", "left_semi").join(rows, F.col("elem_id") == F.col("table_elem_id"), "left").select("section_id", F.lit("table").alias("content_type"), F.lit(0).alias("major"), "elem_id", F.coalesce("content", F.lit("")).alias("content"), F.lit("").alias("url"), "n_rows")
    order = F.row_number().over(W.partitionBy("section_id").orderBy("content_type", "major", "elem_id"))
    return f.unionByName(t).withColumn("order", order).drop("major")


def expansion(sections: DataFrame, media: DataFrame, contains: DataFrame, limit: int = 20, names: DataFrame | None = None, per_word: int = 5) -> DataFrame:
    """What belongs with a section: its title, its media, and entities of its document (document, id), the first ones by id.

    names: entities (id, text); where a document has none, each word of the title brings the first that have it in their name."""
    own = sections.select("section_id", "title", document_of(F.col("section_id")).alias("document"))
    firsts = contains.groupBy("document").agg(F.slice(F.array_sort(F.collect_set("id")), 1, limit).alias("ids"))
    entities = own.join(firsts, "document").select("section_id", F.posexplode("ids").alias("at", "element_id")).select("section_id", F.lit(2).alias("rank"), "at", "element_id", F.lit("entity").alias("kind"))
    if names is not None:
        asked = own.join(firsts.select("document"), "document", "left_anti").select("section_id", F.posexplode(keywords(F.col("title"))).alias("k", "word"))
        hits = containing(names.select("id", "text"), "text", asked.select("word").distinct(), "word").select("word", "id").distinct()
        hits = hits.withColumn("n", F.row_number().over(W.partitionBy("word").orderBy("id"))).filter(F.col("n") <= per_word)
        found = asked.join(hits, "word").groupBy("section_id", "id").agg(F.min("k").alias("k"))
        at = (F.row_number().over(W.partitionBy("section_id").orderBy("k", "id")) - 1).alias("at")
        entities = entities.unionByName(found.select("section_id", F.lit(2).alias("rank"), at, F.col("id").alias("element_id"), F.lit("entity").alias("kind")))
    titles = own.select("section_id", F.lit(0).alias("rank"), F.lit(0).alias("at"), F.col("title").alias("element_id"), F.lit("title").alias("kind"))
    pieces = media.join(own.select("section_id"), "section_id", "left_semi").select("section_id", F.lit(1).alias("rank"), F.col("order").alias("at"), F.col("elem_id").alias("element_id"), F.col("content_type").alias("kind"))
    every = titles.unionByName(pieces).unionByName(entities)
    return every.withColumn("order", F.row_number().over(W.partitionBy("section_id").orderBy("rank", "at"))).select("section_id", "order", "kind", "element_id")


def references(hits: DataFrame) -> DataFrame:
    """Rows (query_id, number, line): the documents of each query's hits (query_id, doc_name, title, page, media, arrival).

    Documents come in the order in which they are first met, each with its first title, its pages in
    order and how many media of each kind it has; hits without media have null there."""
    first = F.min_by("title", "arrival").alias("title")
    media = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("arrival", "media"))), lambda x: x["media"].isNotNull()), lambda x: x["media"]).alias("media")
    docs = hits.groupBy("query_id", "doc_name").agg(F.min("arrival").alias("first"), first, F.collect_set("page").alias("pages"), media)
    number = F.row_number().over(W.partitionBy("query_id").orderBy("first", "doc_name"))
    return docs.withColumn("number", number).select("query_id", "number", reference_line(F.col("number"), F.col("doc_name"), F.col("title"), F.col("pages"), F.col("media")).alias("line"))


def reference_line(number: Column, name: Column, title: Column, pages: Column, media_types: Column) -> Column:
    """`[1] name - title 第1, 2页 (包含2个图片)`."""
    page_text = F.when(F.size(pages) > 0, F.concat(F.lit("第"), F.array_join(F.transform(F.array_sort(pages), lambda p: p.cast("string")), ", "), F.lit("页"))).otherwise(F.lit(""))
    label = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    kinds = F.transform(F.array_distinct(media_types), lambda k: F.concat(F.size(F.filter(media_types, lambda t: t == k)).cast("string"), F.lit("个"), F.coalesce(F.try_element_at(label, k), k)))
    with_media = F.when(F.size(media_types) > 0, F.concat(F.lit(" (包含"), F.array_join(kinds, ", "), F.lit(")"))).otherwise(F.lit(""))
    own_title = F.when((F.coalesce(title, F.lit("")) != "") & (title != name), F.concat(F.lit(" - "), title)).otherwise(F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), name, own_title, F.lit(" "), page_text, with_media)


def render(chosen: DataFrame, media: DataFrame) -> DataFrame:
    """The ordered events (query_id, seq, type, payload) of each answer: title, marked evidence, media, references, summary.

    chosen: one section for each query, with query, intent, section_id, title, doc_name, final_score and evidence."""
    own = media.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("order", "content_type", "elem_id", "content", "url", "n_rows"))).alias("media"))
    rows = chosen.join(own, "section_id", "left").withColumn("media", F.coalesce("media", F.array().cast("array<struct<order:int,content_type:string,elem_id:string,content:string,url:string,n_rows:int>>")))
    kinds = F.transform("media", lambda m: m["content_type"])
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.alias("payload"))
    text = marked(F.col("evidence.content"), F.col("evidence.element_id"), F.array("evidence.element_id"))
    reference = reference_line(F.lit(1), F.col("doc_name"), F.col("title"), F.array_compact(F.array("evidence.page")), kinds)
    summary = F.to_json(F.struct(F.col("query"), F.col("intent").alias("intent_type"), F.struct("section_id", F.round("final_score", 5).alias("score"), "title").alias("selected_section"), F.lit(1).alias("evidence_count"), F.struct(count("image").alias("images"), count("table").alias("tables"), count("chart").alias("charts")).alias("multimodal_summary")))
    events = F.concat(
        F.array(event("answer_chunk", F.concat(F.lit("## "), "title", F.lit("\n\n"))), event("answer_chunk", F.concat(text, F.lit("\n\n")))),
        F.transform("media", lambda m: F.struct(F.lit("multimodal_content").alias("type"), F.to_json(m).alias("payload"))),
        F.array(event("answer_chunk", F.concat(F.lit("\n**参考来源：**\n"), reference, F.lit("\n"))), event("final_answer", summary)),
    )
    return rows.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.*")


def table_view(media: DataFrame) -> DataFrame:
    """Tables as a page shows them: links, and search and pages for long ones."""
    t = media.filter("content_type = 'table'")
    return t.select("section_id", "elem_id", "n_rows", (F.col("n_rows") > 10).alias("enable_search"), (F.col("n_rows") > 20).alias("pagination"), F.concat(F.lit("/api/table/export/"), "elem_id", F.lit("/csv")).alias("export_csv_url"), F.concat(F.lit("/api/file/view/"), document_of(F.col("section_id")).cast("string"), F.lit("?highlight=table")).alias("view_url"))
