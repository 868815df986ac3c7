"""From layout elements to sections, blocks, content units, search documents and relational rows.

All windows and groups are within one document or section; positions are explicit columns, so no
result hangs on the order in which rows arrive. Elements: doc_id, elem_index, elem_type, text, page,
and, where there are any, points, image_path, text_as_html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions.text import blank, strip

DEFAULT_TITLE = "文档内容"
DEFAULT_CAPTION = "图片"
DATE = "2024-01-01"
#: Kinds of blocks by kinds of elements (others are paragraphs), and prefixes of their ids.
BLOCK_TYPES = {"Title": "title", "Header": "title", "NarrativeText": "paragraph", "Text": "paragraph", "ListItem": "paragraph", "Image": "figure", "Table": "table", "Formula": "formula"}
PREFIXES = {"title": "title_t", "figure": "fig_", "table": "tbl_"}
PAGE_WIDTH, PAGE_HEIGHT = 595, 842


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def in_order(value: str, position: str) -> Column:
    """The values of a group in order of a position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).alias("value")))), lambda x: x["value"])


def bounding_box(points: Column) -> Column:
    """First and last point, cut to whole numbers; zeros for fewer than two points."""
    corner = lambda i: F.array(F.element_at(points, i)["x"].cast("int"), F.element_at(points, i)["y"].cast("int"))
    zero = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0)))
    return F.when(F.size(points) >= 2, F.array(corner(1), corner(-1))).otherwise(zero)


def normalised_box(box: Column) -> Column:
    """A bounding box as shares of an A4 page, to four digits; zeros where there is none."""
    share = lambda i, j, whole: F.coalesce(F.round(box[i][j] / whole, 4), F.lit(0.0))
    return F.struct(share(0, 0, PAGE_WIDTH).alias("x1"), share(0, 1, PAGE_HEIGHT).alias("y1"), share(1, 0, PAGE_WIDTH).alias("x2"), share(1, 1, PAGE_HEIGHT).alias("y2"))


def table_html(html: Column, text: Column) -> Column:
    """The table's HTML with the class multimodal-table on its first table tag; without HTML, the text in one cell."""
    tag = r"(?s)^(.*?)<table([^>]*?)"
    classed = F.regexp_replace(html, tag + r"class=[\"']([^\"']*)[\"']([^>]*?)>", '$1<table$2class="multimodal-table $3"$4>')
    plain = F.regexp_replace(html, tag + ">", '$1<table$2 class="multimodal-table">')
    cell = F.concat(F.lit('<table class="multimodal-table"><tr><td>'), text, F.lit("</td></tr></table>"))
    return F.when(html.isNull(), cell).when(~F.contains(html, F.lit("<table")), html).when(F.contains(html, F.lit("class=")), classed).otherwise(plain)


def image_path(doc: Column, page: Column, number: Column, stamp: Column) -> Column:
    return F.format_string("%s_page%03d_img%02d_%s.jpg", F.substring(doc, 1, 20), page, number, stamp)


def html_columns(html: Column) -> Column:
    """Cells of the first row, 1 at least."""
    row = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<tr[^>]*>(.*?)</tr>", 1)
    return F.greatest(F.regexp_count(row, F.lit(r"(?i)<t[hd][^>]*>")), F.lit(1))


def blocks(elements: DataFrame, date: str = DATE) -> DataFrame:
    """Elements as blocks of sections: a title starts a section; what stands before the first is in a default one."""
    rows = elements.filter(~blank(F.col("text")))
    doc = W.partitionBy("doc_id").orderBy("elem_index")
    so_far = doc.rowsBetween(W.unboundedPreceding, 0)
    starts = F.coalesce(F.col("elem_type").isin("Title", "Header"), F.lit(False))
    # all windows are in one order, so a document's texts are sorted and held once
    rows = rows.withColumn("text", strip(F.col("text"))).withColumn("group", F.sum(starts.cast("int")).over(so_far)).withColumn("at", F.row_number().over(doc))
    first = F.first("group").over(so_far)
    block_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() for x in kv]), F.col("elem_type")), F.lit("paragraph"))
    order = F.col("at") + 1 - F.max(F.when(starts | (F.col("at") == 1), F.col("at"))).over(so_far)
    rows = rows.withColumn("section_no", (F.col("group") + 1 - first).cast("int")).withColumn("order", order).withColumn("type", block_type)
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("type")), F.lit("para_p"))
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.concat("elem_id", F.lit("_r"), (i + 1).cast("string")).alias("row_id"), strip(t).alias("row_text")))
    return rows.select(
        "doc_id", "section_no", F.format_string(f"%s_doc#{date}#%s_%04d", F.col("doc_id").cast("string"), F.col("doc_id").cast("string"), "section_no").alias("section_id"), "elem_index", "order",
        F.concat(prefix, F.col("order").cast("string")).alias("elem_id"), "type", F.coalesce("page", F.lit(1)).alias("page"), bounding_box(_optional(elements, "points", "array<struct<x:double,y:double>>")).alias("bbox"), "text",
        F.when(F.col("type") == "figure", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(DEFAULT_CAPTION))).alias("caption"), _optional(elements, "image_path", "string").alias("image_path"),
        F.when(F.col("type") == "table", table_html(_optional(elements, "text_as_html", "string"), F.col("text"))).alias("html"),
    ).withColumn("rows", F.when(F.col("type") == "table", F.filter(lines, lambda r: r["row_text"] != "")))


def sections(blocks_: DataFrame) -> DataFrame:
    title = F.max(F.when((F.col("order") == 1) & (F.col("type") == "title"), F.col("text")))
    return blocks_.groupBy("doc_id", "section_no", "section_id").agg(
        F.coalesce(title, F.lit(DEFAULT_TITLE)).alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_join(in_order("text", "order"), "\n").alias("full_text"), F.count("*").cast("int").alias("n_blocks"),
    )


def block_text() -> Column:
    """What a block says: the rows of a table, the caption of a figure, else its text."""
    rows = F.array_join(F.transform("rows", lambda r: r["row_text"]), " ")
    return F.when((F.col("type") == "table") & (F.size("rows") > 0), rows).when(F.col("type") == "figure", F.coalesce(F.when(~blank(F.col("caption")), F.col("caption")), F.col("text"))).otherwise(F.col("text"))


def content_units(blocks_: DataFrame) -> DataFrame:
    """Titles, whole sections and fragments in order, numbered from 0 in each document."""
    parts = sections(blocks_)
    titles = parts.filter(~blank(F.col("title"))).select("doc_id", "section_no", F.lit(0).alias("rank"), F.lit(0).alias("order"), F.col("section_id").alias("element_id"), "section_id", "title", F.col("title").alias("content"), F.lit("title").alias("content_type"), F.col("page_start").alias("page"))
    whole = parts.filter(~blank(F.col("full_text")) & (F.col("full_text") != F.col("title"))).select("doc_id", "section_no", F.lit(1).alias("rank"), F.lit(0).alias("order"), F.concat("section_id", F.lit("_full")).alias("element_id"), "section_id", "title", F.col("full_text").alias("content"), F.lit("section").alias("content_type"), F.col("page_start").alias("page"))
    fragments = (
        blocks_.filter("type <> 'title'").withColumn("content", block_text()).filter(~blank(F.col("content"))).join(parts.select("section_id", "title"), "section_id")
        .select("doc_id", "section_no", F.lit(2).alias("rank"), "order", F.col("elem_id").alias("element_id"), "section_id", "title", "content", F.lit("fragment").alias("content_type"), "page")
    )
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("section_no", "rank", "order")) - 1
    out = titles.unionByName(whole).unionByName(fragments).withColumn("chunk_index", index)
    return out.select(F.concat_ws("_", "doc_id", "chunk_index").alias("id"), "doc_id", "chunk_index", "element_id", "section_id", "title", "content", "content_type", "page")


def search_documents(blocks_: DataFrame, collide: bool = False) -> DataFrame:
    """A document for each section and for each block. collide: block keys without their section, of which the last one stays."""
    rows = blocks_.withColumn("content", block_text())
    says = ~blank(F.col("content"))
    title = F.coalesce(F.max(F.when((F.col("order") == 1) & (F.col("type") == "title"), F.col("text"))), F.lit(DEFAULT_TITLE))
    # one group for each section makes all of its documents, so texts are shuffled once, by the windows of `blocks`
    parts = F.array_sort(F.collect_list(F.when(says, F.struct("order", "content", "elem_id", "page")))).alias("parts")
    made = rows.groupBy("doc_id", "section_no", "section_id").agg(title.alias("title"), parts).filter("size(parts) > 0")
    doc = F.col("doc_id").cast("string")
    whole = F.struct(
        F.concat(doc, F.lit("_section_"), "section_id").alias("_id"), F.col("section_id").alias("element_id"), F.array_join(F.transform("parts", lambda p: p["content"]), " ").alias("content"),
        F.col("title").alias("summary"), F.lit("section").alias("content_type"), F.col("parts")[0]["page"].alias("page"),
    )
    key = lambda p: p["elem_id"] if collide else F.concat("section_id", F.lit("_"), p["elem_id"])
    summary = lambda c: F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)
    each = F.transform("parts", lambda p: F.struct(F.concat(doc, F.lit("_fragment_"), key(p)).alias("_id"), p["elem_id"].alias("element_id"), p["content"].alias("content"), summary(p["content"]).alias("summary"), F.lit("fragment").alias("content_type"), p["page"].alias("page")))
    columns = ["_id", "doc_id", "section_id", "element_id", "title", "content", "summary", "content_type", "page"]
    out = made.select("doc_id", "section_no", "section_id", "title", F.explode(F.concat(F.array(whole), each)).alias("d")).select("doc_id", "section_no", "section_id", "title", "d.*").select(*columns, "section_no")
    if collide:
        out = out.filter("content_type = 'section'").unionByName(latest(out.filter("content_type = 'fragment'"), ["_id"], "section_no"))
    return out.select(*columns)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version for each key, by a mergeable aggregate."""
    value = F.max_by(F.struct(*[c for c in df.columns]), version).alias("row")
    return df.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(value).select("row.*")


def text_offsets(blocks_: DataFrame) -> DataFrame:
    """Where each block begins and ends in the document's texts joined by single blanks."""
    w = W.partitionBy("doc_id").orderBy("elem_index").rowsBetween(W.unboundedPreceding, -1)
    rows = blocks_.withColumn("content", block_text()).filter(~blank(F.col("content"))).withColumn("start", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)))
    return rows.select("doc_id", "section_id", "section_no", "elem_index", "elem_id", "page", "content", "start", (F.col("start") + F.length("content")).alias("end"))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping pieces of a text."""
    step = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def figure_rows(blocks_: DataFrame) -> DataFrame:
    return blocks_.filter("type = 'figure'").select(F.concat_ws("_", "section_id", "elem_id").alias("elem_id"), "section_id", "image_path", "caption", "page", normalised_box(F.col("bbox")).alias("bbox_norm"))


def table_heads(blocks_: DataFrame) -> DataFrame:
    """n_cols: the number of fields of a parsed row (2) or, without rows, the cells of the first HTML row; n_cols_html: the latter always."""
    n = F.coalesce(F.size("rows"), F.lit(0))
    return blocks_.filter("type = 'table'").select("doc_id", F.concat_ws("_", "section_id", "elem_id").alias("elem_id"), "section_id", F.col("html").alias("table_html"), n.alias("n_rows"), F.when(n > 0, F.lit(2)).otherwise(html_columns(F.col("html"))).alias("n_cols"), html_columns(F.col("html")).alias("n_cols_html"))


def table_lines(blocks_: DataFrame) -> DataFrame:
    rows = blocks_.filter("type = 'table'").select("section_id", F.concat_ws("_", "section_id", "elem_id").alias("table_elem_id"), F.posexplode("rows").alias("row_index", "row"))
    return rows.select("section_id", "table_elem_id", "row_index", F.col("row.row_text").alias("row_text"), F.to_json("row").alias("row_json"))


def row_text(fields: Column) -> Column:
    """`key: value` pairs of a map, without row_text, row_cells and empty values."""
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin("row_text", "row_cells") & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
