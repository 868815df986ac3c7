"""Column functions for text: trimming, tokens, query normalisation, names and small parsers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a query that say nothing, and synonyms (a string replaces the key; a list is replaced by it).
LOW_INFORMATION = ["帮我", "请", "查询", "查找", "搜索", "一下", "相关", "内容"]
SYNONYMS: dict[str, str | list[str]] = {
    "HCP": ["宿主细胞蛋白", "Host Cell Protein", "host cell protein"],
    "CHO": ["中国仓鼠卵巢", "Chinese Hamster Ovary", "中国仓鼠卵巢细胞"],
    "CHO-K1": "CHOK1",
    "CHO K1": "CHOK1",
}
#: Words of titles, and patterns of names in queries.
TITLE_WORDS = ["HCP", "CHO", "蛋白", "细胞", "培养", "检测", "分析", "质量", "标准", "试剂", "产品", "设备", "方法", "技术", "系统", "平台", "服务"]
QUERY_ENTITIES: dict[str, list[str]] = {
    "bio_entity": ["HCP|宿主细胞蛋白", "CHO|中国仓鼠卵巢", r"细胞株|cell\s*line", "培养基|medium", "抗体|antibody", "蛋白质|protein"],
    "product_model": [r"[A-Z]{2,5}\d{2,6}", r"[A-Z]+\-\d+", r"v\d+\.\d+"],
}
VECTOR_SUFFIX = {"title": " 定义 概念 含义 简介", "fragment": " 详细 具体 方法 操作 流程"}
#: English stop words of common full-text analyzers (fixed values).
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
EXTENSIONS = ["pdf", "doc", "docx", "txt", "md", "xls", "xlsx", "ppt", "pptx", "jpg", "jpeg", "png"]
MOST_BYTES = 104_857_600


#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, any Unicode white space."""
    return F.trim(c, F.lit(BLANKS))


def blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


#: Patterns of a character that is a token by itself, and of those that make tokens together.
HAN, LETTER = r"\p{IsHan}", r"[\p{L}\p{N}&&[^\p{IsHan}]]"


def tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased words of letters and digits; every Han character by itself; no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"{HAN}|{LETTER}+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def words(c: Column) -> Column:
    """Lower-cased parts between white space."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility normalisation; there is no SQL function for it."""
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_width(c: Column) -> Column:
    """Full-width digits and letters as ASCII, dashes as hyphens."""
    wide = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])) + "－—–"
    plain = "".join(chr(ord(x) - 0xFEE0) for x in wide[:-3]) + "---"
    return F.translate(c, wide, plain)


def normalise_query(c: Column, synonyms: Mapping[str, str | list[str]] = SYNONYMS, low: Sequence[str] = LOW_INFORMATION) -> Column:
    """Strip, NFKC, single spaces, ASCII marks, spaces between Han and Latin, synonyms in order, no empty words."""
    out = collapse(nfkc(strip(c)))
    out = F.translate(out, "，。；", ",.;")
    out = F.regexp_replace(out, "([一-鿿])([a-zA-Z])", "$1 $2")
    out = F.regexp_replace(out, "([a-zA-Z])([一-鿿])", "$1 $2")
    for key, value in synonyms.items():
        for old, new in [(key, value)] if isinstance(value, str) else [(v, key) for v in value]:
            out = F.replace(out, F.lit(old), F.lit(new))
    parts = F.filter(F.split(out, r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(parts, lambda w: ~w.isin(*low))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(out)


def keywords(c: Column, most: int = 10) -> Column:
    """The first words of more than one character, by Unicode word characters."""
    return F.slice(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 1), 1, most)


def vector_query(c: Column, intent: Column) -> Column:
    return F.concat(c, F.when(intent == "title", F.lit(VECTOR_SUFFIX["title"])).when(intent == "fragment", F.lit(VECTOR_SUFFIX["fragment"])).otherwise(F.lit("")))


def query_entities(c: Column, patterns: Mapping[str, list[str]] = QUERY_ENTITIES) -> Column:
    """Distinct names in a query by kind, in sorted order; none at all: the query itself as `general`."""
    found = {kind: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?iU){p}"), F.lit(0)) for p in ps])))) for kind, ps in patterns.items()}
    none = F.lit(True)
    for names in found.values():
        none &= F.size(names) == 0
    return F.struct(*[names.alias(kind) for kind, names in found.items()], F.when(none, F.array(c)).otherwise(F.array().cast("array<string>")).alias("general"))


def expand(names: Column, synonyms: Mapping[str, str | list[str]] = SYNONYMS, more: Mapping[str, list[str]] | None = None) -> Column:
    """Names with their synonyms both ways, sorted and distinct."""
    pairs: dict[str, set[str]] = {}
    for key, value in synonyms.items():
        for v in [value] if isinstance(value, str) else value:
            pairs.setdefault(key, set()).add(v)
            pairs.setdefault(v, set()).add(key)
    for key, values in (more or {}).items():
        pairs.setdefault(key, set()).update(values)
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in sorted(v)]))])
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(names, F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), none))))))


def title_similarity(c: Column, title_words: Sequence[str] = TITLE_WORDS) -> Column:
    """Jaccard similarity with the title words; short queries gain 0.1, long ones lose it; 1 at most."""
    own = F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    listed = F.array(*[F.lit(w) for w in title_words])
    base = F.size(F.array_intersect(own, listed)) / F.size(F.array_union(own, listed))
    return F.least(base + F.when(F.length(c) <= 5, F.lit(0.1)).when(F.length(c) > 20, F.lit(-0.1)).otherwise(F.lit(0.0)), F.lit(1.0))


def lexical_intent(c: Column) -> Column:
    s = title_similarity(c)
    return F.when(s >= 0.45, F.lit("title")).when(s >= 0.40, F.lit("hybrid")).otherwise(F.lit("fragment"))


def extension(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1)))


def allowed_upload(name: Column, size: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    return F.coalesce(extension(name).isin(*extensions) & (size <= MOST_BYTES), F.lit(False))


def safe_name(name: Column) -> Column:
    """No path or control characters, no blanks or dots at the ends, 200 characters at most with the extension kept."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    clean = F.when(F.length(F.coalesce(name, F.lit(""))) == 0, F.lit("unknown")).when(clean == "", F.lit("unknown_file")).otherwise(clean)
    ending = F.regexp_extract(clean, r"[^.](\.[^.]*)$", 1)
    return F.when(F.length(clean) > 200, F.concat(F.substring(clean, F.lit(1), F.lit(200) - F.length(ending)), ending)).otherwise(clean)


def timeout_seconds(c: Column) -> Column:
    """60, '60s', '1.5m' or '1h' in whole seconds; anything else: 60."""
    text = F.lower(strip(c.cast("string")))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([smh]?)$", 1)
    unit = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([smh]?)$", 2)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    return F.coalesce(F.when(number != "", F.floor(number.cast("double") * scale)).cast("int"), F.lit(60))


@F.pandas_udf(T.StringType())
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as UTF-8, or as GBK where they are no UTF-8; the JVM refuses GBK by default."""

    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(raw).decode("gbk", "replace")

    for s in batches:
        yield s.map(one)


def marked_pattern(terms: Column) -> Column:
    return F.concat(F.lit("(?iU)\\b("), F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")), "|"), F.lit(")\\b"))


def highlight_whole(title: Column, terms: Column) -> Column:
    """A whole title with the terms in em tags."""
    return F.when(F.size(terms) > 0, F.regexp_replace(title, marked_pattern(terms), F.lit("<em>$1</em>"))).otherwise(title)


def highlight(content: Column, terms: Column, most: int = 3, width: int = 100) -> Column:
    """Up to `most` fragments of `width` characters that have a term, the terms in em tags."""
    pattern = marked_pattern(terms)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(content) - 1) / width)).cast("int")), lambda i: F.substring(content, i * width + 1, F.lit(width)))
    hit = F.filter(parts, lambda p: F.regexp_like(p, pattern))
    return F.when(F.size(terms) > 0, F.transform(F.slice(hit, 1, most), lambda p: F.regexp_replace(p, pattern, F.lit("<em>$1</em>")))).otherwise(F.array().cast("array<string>"))


#: Characters over which patterns and texts meet, and patterns that are sent to the texts rather than the texts' grams to them.
GRAM, FEW = 3, 100_000


def grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """rows with every pattern that their text contains, by equal characters first and the whole pattern then.

    A pattern meets the texts that have its last GRAM characters (all of a shorter one), in an equi-join
    that neither side has to be small for. Grams go with a hash of their text; texts join once for each
    pattern that may be in them. Only grams as long as some pattern's are made, and up to FEW patterns go to where the
    texts are, so that no gram is shuffled. Patterns count once; null and empty ones are in no text."""
    asked = patterns.filter(F.length(pattern) > 0).select(pattern, F.when(F.length(pattern) > GRAM, F.substring(pattern, -GRAM, GRAM)).otherwise(F.col(pattern)).alias("__gram")).distinct()
    found = asked.agg(F.count("*").alias("n"), F.collect_set(F.length("__gram")).alias("sizes")).first()  # GRAM sizes at most
    exploded = rows.select(F.xxhash64(text).alias("__text"), F.explode(F.concat(*[grams(F.col(text), n) for n in sorted(found["sizes"]) or [GRAM]])).alias("__gram"))
    candidates = exploded.join(F.broadcast(asked) if found["n"] <= FEW else asked, "__gram").select("__text", pattern).distinct()
    return rows.withColumn("__text", F.xxhash64(text)).join(candidates, "__text").filter(F.contains(F.col(text), F.col(pattern))).drop("__text")


def encoder_input(c: Column, most: int = 512, marks: bool = False, lower: bool = False) -> Column:
    """A text as encoders take it: single blanks, optionally only letters, digits and blanks, optionally in lower case, its first characters, stripped."""
    out = collapse(c)
    if marks:
        out = F.regexp_replace(out, r"(?U)[^\w\s一-鿿]", "")
    if lower:
        out = F.lower(out)
    return strip(F.substring(out, 1, most))


def valid_query(c: Column) -> Column:
    """Whether a query has 1 to 1000 characters once it is stripped."""
    return F.coalesce(F.length(strip(c)).between(1, 1000), F.lit(False))


#: Marks of pictures, tables and charts in answers, with the class and sign that a page shows.
REFERENCES = {"图片": ("image-ref", "🖼️"), "表格": ("table-ref", "📊"), "图表": ("chart-ref", "📈")}


def inline_references(c: Column) -> Column:
    """Marks like [图片:id] as the page's inline references."""
    for mark, (kind, sign) in REFERENCES.items():
        c = F.regexp_replace(c, rf"\[{mark}:([^\]]+)\]", f'<span class="inline-reference {kind}" data-element-id="$1">{sign} $1</span>')
    return c


def html_table(headers: Column, rows: Column) -> Column:
    """Rows of cells as the page's HTML table; null cells are empty, no rows at all give an empty text."""
    cells = lambda tag, row: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda x: F.concat(F.lit(f"<{tag}>"), F.coalesce(x, F.lit("")), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda row: cells("td", row)), "")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(F.concat(F.lit('<table class="multimodal-table"><thead>'), cells("th", headers), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>")))


#: Kinds of files that the page takes, fewer than the server does, and states in which it shows a file as being processed.
PAGE_EXTENSIONS = ["pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "md"]
IN_PROCESS = ["pending", "extracting", "vectorizing", "graph_processing"]


def page_upload(name: Column, size: Column) -> Column:
    """Whether the page takes a file; a name without a dot is its own extension there."""
    return F.coalesce(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*PAGE_EXTENSIONS) & (size <= MOST_BYTES), F.lit(False))


def in_process(status: Column) -> Column:
    return F.coalesce(status.isin(*IN_PROCESS), F.lit(False))
