"""Mentions, entities and relations of texts.

Texts: (doc_id, text). Spans are in characters, [start, end); `pos` is a span's place in its document's
list, which decides ties. All joins carry the document's id, so no range join runs over a whole table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions.text import BLANKS, fold_width
from tessellum.operators.intervals import overlapping
from tessellum.operators.retrieval import HashedEncoder, cosine, unit_vectors

#: Rule patterns of entities, patterns of relations, and relations by the kinds of their ends.
NER_PATTERNS = [
    ("CellLine", "CHO-?K?1?"), ("CellLine", r"HEK\s*293"), ("CellLine", "Vero"), ("CellLine", "MDCK"), ("Protein", "HCP"), ("Protein", "宿主.*?蛋白"), ("Protein", "蛋白质?"), ("Protein", "抗体"), ("Protein", "单.*?抗体"),
    ("Reagent", "试剂"), ("Reagent", "缓冲液"), ("Reagent", "底物"), ("Product", "试剂盒"), ("Product", "ELISA"), ("Product", "Western"), ("Product", "kit"), ("Metric", r"\d+.*?%.*?覆盖率"), ("Metric", "线性范围"), ("Metric", "灵敏度"), ("Metric", "精密度"),
]
RELATION_PATTERNS = [
    ("produces", r"(\w+)\s*生产\s*(\w+)"), ("produces", r"(\w+)\s*produces?\s*(\w+)"), ("produces", r"(\w+)\s*制备\s*(\w+)"), ("contains", r"(\w+)\s*含有\s*(\w+)"), ("contains", r"(\w+)\s*包含\s*(\w+)"), ("contains", r"(\w+)\s*contains?\s*(\w+)"),
    ("detects", r"检测\s*(\w+)\s*的\s*(\w+)"), ("detects", r"(\w+)\s*检测\s*(\w+)"), ("detects", r"detect\s*(\w+)\s*in\s*(\w+)"), ("measures", r"(\w+)\s*测量\s*(\w+)"), ("measures", r"(\w+)\s*measures?\s*(\w+)"),
]
TYPE_PAIRS = [("CellLine", "Protein", "produces"), ("Product", "Protein", "detects"), ("Reagent", "Product", "used_in"), ("Protein", "Metric", "has_property")]
PRIORITIES = {"CellLine": 1, "Protein": 2, "Reagent": 3, "Product": 4, "Metric": 5}
LINK_SCORE, NIL_SCORE = 0.7, 0.5


def lexicon(entries: DataFrame) -> DataFrame:
    """Terms (term, canonical, type, priority) from (canonical, type, aliases, ord): names, aliases and their plain forms; the last of equal terms stays."""
    names = entries.select("ord", "canonical", "type", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "name"))
    # the last entry of equal names by a hash aggregate of numbers, so that only different names are sorted by the aggregate of structs
    names = names.groupBy("at", "canonical", "type", "name").agg(F.max("ord").alias("ord"))
    rows = names.select("ord", "at", "canonical", "type", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("name").alias("term")), F.struct(F.lit(1).alias("k"), fold_width(F.col("name")).alias("term")))).alias("t")).filter("t.term <> ''")
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.col("type")), F.lit(99))
    last = F.max_by(F.struct("canonical", "type"), F.struct("ord", "at", "t.k")).alias("last")
    return rows.groupBy(F.lower("t.term").alias("term")).agg(last).select("term", "last.canonical", F.col("last.type").alias("type")).withColumn("priority", priority)


#: Rows that a scan holds before it sends them on, however many a batch of texts gives.
HELD = 16_384


def _sent(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of HELD."""
    while part := list(islice(rows, HELD)):
        yield pd.DataFrame(part, columns=columns)


def _automaton(rows: Sequence[tuple]):
    """The automaton of terms (term, …), whose values are places of rows."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, row in enumerate(rows):
        automaton.add_word(row[0], i)
    automaton.make_automaton()
    return automaton


def _held(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of HELD."""
    while part := list(islice(rows, HELD)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)


def scan(texts: DataFrame, terms: Sequence[tuple], around: int = 0) -> DataFrame:
    """Every occurrence of every term (term, canonical, type, priority), overlapping ones and those within words too.

    The terms are a dictionary that goes along with the plan; the automaton runs over Arrow batches.
    around: with the `context` of each of so many characters on both sides, so that texts need not meet their mentions again."""
    rows = [(str(t[0]).lower(), t[1], t[2], int(t[3])) for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rows)

        def found(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for last, i in automaton.iter(low(text or "")) if rows else ():
                    term, canonical, kind, priority = rows[i]
                    end = last + 1
                    start = end - len(term)
                    beside = (f"{text[max(start - around, 0) : start]} {text[end : end + around]}".strip(" "),) if around else ()
                    yield (doc, start, end, text[start:end], canonical, kind, priority, *beside)

        for batch in batches:
            yield from _held(found(batch), names, types)

    names = ["doc_id", "start", "end", "text", "canonical", "type", "priority", *(["context"] if around else [])]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), *([pa.string()] if around else [])]
    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, end int, text string, canonical string, type string, priority int" + (", context string" if around else ""))


def scan_columns(texts: DataFrame, terms: Sequence[tuple]) -> DataFrame:
    """The same by column functions, for few terms that don't overlap themselves: the text is split before every place that has the term."""
    before = F.concat(F.lit(r"(?=\Q"), "term", F.lit(r"\E)"))
    listed = F.array(*[F.struct(F.lit(str(t[0]).lower()).alias("term"), F.lit(t[1]).alias("canonical"), F.lit(t[2]).alias("type"), F.lit(int(t[3])).alias("priority")) for t in terms])
    pairs = texts.select("doc_id", F.col("text").alias("body"), F.explode(F.filter(listed, lambda t: F.contains(F.lower("text"), t["term"]))).alias("t")).select("doc_id", "body", "t.*")
    pieces = pairs.select("doc_id", "term", "canonical", "type", "priority", F.posexplode(F.split("body", F.concat(F.lit("(?iu)"), before))).alias("k", "piece"))
    w = W.partitionBy("doc_id", "term").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    rows = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("int")).withColumn("n", F.length("term"))
    rows = rows.withColumn("text", F.concat("piece", F.coalesce(F.lead("piece").over(W.partitionBy("doc_id", "term").orderBy("k")), F.lit("")))).filter(F.startswith(F.lower("text"), F.col("term")))
    return rows.select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), F.substring("text", F.lit(1), F.col("n")).alias("text"), "canonical", "type", "priority")


#: Characters of a piece of text, terms of a part of a dictionary, and pieces of a share of the texts.
PIECE, PART, SHARE = 4096, 100_000, 2000


def low(text: str) -> str:
    """In lower case, a character for a character: what would become longer, or hangs on its neighbours, goes by itself."""
    if "\u0130" not in text and "\u03a3" not in text:
        return text.lower()
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan_table(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """`scan` with a dictionary of any size in a table (term, canonical, type, priority), of which no task holds the whole.

    The dictionary is dealt into parts of about PART entries, and texts are cut into pieces that overlap by the
    longest term and dealt into shares of about SHARE. Each part meets each share: sorted rows go by, first the
    part's entries, of which an automaton is made, then the pieces that it runs over. So a task holds one part, and texts
    are sent once for each part. Equal terms: each gives its rows. Terms
    with U+0130, which `scan` can't find, are found. Empty terms and null texts give none."""
    listed = terms.select("term", "canonical", "type", F.col("priority").cast("int").alias("priority")).filter("length(term) > 0")
    sizes = listed.agg(F.count("*").alias("n"), F.max(F.length("term")).alias("most")).first()
    rows = texts.select("doc_id", "text").filter("length(text) > 0")
    last = F.floor((F.length("text") - 1) / PIECE).cast("int")
    shares = -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // SHARE)
    parts, most = -(-sizes["n"] // PART), sizes["most"] or 1
    pieces = rows.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE + most - 1)).alias("body"))
    share = F.pmod(F.xxhash64("doc_id", "piece", "body"), F.lit(max(shares, 1))).cast("int").alias("share")
    own = F.pmod(F.xxhash64(*listed.columns), F.lit(max(parts, 1))).cast("int").alias("part")
    entries = listed.groupBy(*listed.columns).agg(F.count("*").alias("times")).select(own, F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))).alias("share"), F.lit(0).alias("kind"), F.col("term").alias("body"), "canonical", "type", "priority", "times")
    asked = pieces.select(F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part"), share, F.lit(1).alias("kind"), "doc_id", "piece", "body")
    schema = asked.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text")).crossJoin(listed.select("canonical", "type", "priority")).schema
    names, piece_size, held = schema.names, PIECE, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, automaton, of_term, types = None, None, {}, None

        def found(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal at, automaton, of_term
            for part, share, kind, body, canonical, type_, priority, times, doc, piece in zip(*[batch.column(c).to_pylist() for c in ("part", "share", "kind", "body", "canonical", "type", "priority", "times", "doc_id", "piece")]):
                if at != (part, share):
                    at, automaton, of_term = (part, share), None, {}
                if kind == 0:
                    of_term.setdefault(low(body), []).extend([(canonical, type_, priority)] * times)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for term, own in of_term.items():
                        automaton.add_word(term, (len(term), own))
                    automaton.make_automaton()
                for end, (n, own) in automaton.iter(low(body)) if of_term else ():
                    begin = end + 1 - n
                    if begin < piece_size:
                        for entry in own:
                            yield (doc, piece * piece_size + begin, piece * piece_size + begin + n, body[begin : end + 1], *entry)

        for batch in batches:
            if types is None:
                field = {f.name: f.type for f in batch.schema}
                types = [field["doc_id"], pa.int32(), pa.int32(), *[field[c] for c in ("body", "canonical", "type", "priority")]]
            hits = found(batch)
            while rows := list(islice(hits, held)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    every = entries.unionByName(asked, allowMissingColumns=True)
    return every.repartition(max(parts * shares, 1), "part", "share").sortWithinPartitions("part", "share", "kind").mapInArrow(run, schema)


def resolve(spans: DataFrame) -> DataFrame:
    """One span of each conflict: in order of starts and ends, a group is a span and all later ones that begin before its end; its first of the least priority number stays.

    Sorted spans go by one after the other, and a task keeps the group at hand alone, so a document may
    have any number of them. Spans without a start or end are left out."""
    fields = ["start", "end", "priority", "text", "canonical", "type"]
    schema = spans.select("doc_id", F.lit(0).alias("pos"), *fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_group, limit, pos, lead, held = None, False, 0, 0, None, None

        def shaped(rows: pa.RecordBatch, places: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(places, pa.int32()), *rows.columns[1:]], schema.names)

        for batch in batches:
            best, kept, places = None, [], []  # best: the row in this batch that leads the group; held: the one of an earlier batch
            for i, (d, start, end, priority) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "end", "priority")])):
                if open_group and d == doc and start < limit:
                    if priority is not None and lead is not None and priority < lead:
                        best, lead, held = i, priority, None
                    continue
                if held is not None:
                    yield shaped(held, [pos])
                    held = None
                elif best is not None:
                    kept.append(best), places.append(pos)
                pos = pos + 1 if open_group and d == doc else 0
                doc, open_group, limit, lead, best = d, True, end, priority, i
            if kept:
                yield shaped(batch.take(pa.array(kept)), places)
            if best is not None:
                held = batch.take(pa.array([best]))
        if held is not None:
            yield shaped(held, [pos])

    rows = spans.select("doc_id", *fields).filter("start is not null and end is not null")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *fields).mapInArrow(run, schema)


def pattern_entities(texts: DataFrame, patterns: Sequence[tuple[str, str]] = NER_PATTERNS, confidence: float = 0.8) -> DataFrame:
    """All matches of (type, pattern) whatever the case, in order of patterns and places. SQL patterns give no offsets, so this is Python over batches."""
    compiled = [(kind, p) for kind, p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in compiled]

        def found(batch: pd.DataFrame) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                matches = ((kind, m) for kind, rule in rules for m in rule.finditer(text or ""))
                for n, (kind, m) in enumerate(matches):
                    yield doc, n, m.start(), m.end(), m.group(), kind, confidence

        for batch in batches:
            yield from _sent(found(batch), ["doc_id", "pos", "start", "end", "text", "type", "confidence"])

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, start int, end int, text string, type string, confidence double")


def statistical_entities(texts: DataFrame, patterns: Sequence[tuple[str, str]] = NER_PATTERNS, post_process: bool = True) -> DataFrame:
    """Entities by patterns. With a tokenizer at hand (post_process) equal spans and neighbours become one and low ones fall out; else the matches as they are."""
    found = pattern_entities(texts, patterns)
    return with_bucket(merge_adjacent(distinct_spans(found))) if post_process else found


def anchor_records(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors as entities, sure and of a source of their own, with the block that they start in."""
    return align(anchors, blocks).withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("rule_anchor"))


def summary(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows (doc_id, entities, anchors, merged, linked, relations) of a document's extraction.

    mentions: (doc_id, source, linking_status); relations: (doc_id, evidence_count). merged: relations of several evidences."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    m = mentions.groupBy("doc_id").agg(F.count("*").alias("entities"), is_("source", "rule_anchor").alias("anchors"), is_("linking_status", "linked").alias("linked"))
    r = relations.groupBy("doc_id").agg(F.count("*").alias("relations"), F.count_if(F.col("evidence_count") > 1).alias("merged"))
    return m.join(r, "doc_id", "full").fillna(0).select("doc_id", "entities", "anchors", "merged", "linked", "relations")


def distinct_spans(spans: DataFrame) -> DataFrame:
    """The first of spans with the same place and type."""
    rank = F.row_number().over(W.partitionBy("doc_id", "start", "end", "type").orderBy("pos"))
    return spans.withColumn("__n", rank).filter("__n = 1").drop("__n")


def merge_adjacent(spans: DataFrame) -> DataFrame:
    """Neighbours of one type that touch become one: texts put together, the least confidence; gaps and islands."""
    w = W.partitionBy("doc_id").orderBy("start", "pos")
    joins = (F.lag("end").over(w) == F.col("start")) & (F.lag("type").over(w) == F.col("type"))
    rows = spans.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "pos", "text", "end")))
    return rows.groupBy("doc_id", "__island").agg(parts.alias("p"), F.first("type").alias("type"), F.min("confidence").alias("confidence")).select(
        "doc_id", F.col("p")[0]["pos"].alias("pos"), F.col("p")[0]["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "type", "confidence",
    )


def with_bucket(spans: DataFrame, least: float = 0.5) -> DataFrame:
    bucket = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return spans.filter(F.col("confidence") >= least).withColumn("bucket", bucket)


def merge_with_anchors(anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """All anchors, then entities that overlap none, each in order of starts; `pos` counts through both."""
    places = ["doc_id", "start", "end"]
    taken = overlapping(entities.select(*places).distinct(), anchors.select("doc_id", F.col("start").alias("a_start"), F.col("end").alias("a_end")), ["doc_id"], right_span=("a_start", "a_end"))
    free = entities.join(taken.select(*places).distinct(), places, "left_anti")
    both = anchors.select("doc_id", F.lit(0).alias("src"), "pos", "start", "end", "text", "type", F.lit(1.0).alias("confidence"), F.lit("rule_anchor").alias("source")).unionByName(free.select("doc_id", F.lit(1).alias("src"), "pos", "start", "end", "text", "type", "confidence", F.lit("statistical_ner").alias("source")))
    pos = (F.row_number().over(W.partitionBy("doc_id").orderBy("src", "start", "pos")) - 1).alias("pos")
    return both.select("doc_id", pos, "start", "end", "text", "type", "confidence", "source")


#: Bins of a document have 2^BIN places.
BIN = 16


def attached(rows: DataFrame, spans: DataFrame, deep: int = 1) -> DataFrame:
    """rows (doc_id, start, ...) with `spans`: those of their document, of at most `deep` that overlap in a place, that they start in.

    The starts of both sides go by once in their order, and a row takes the spans that began last; those that end after it
    stay. A span lies in each bin of places that it reaches, so a long document is many groups."""
    fields = [c for c in spans.columns if c != "doc_id"]
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    bin_of = lambda c: F.shiftright(c, BIN)
    begins = spans.filter("doc_id is not null and end > start").select("doc_id", F.explode(F.sequence(bin_of(start), bin_of(end - 1))).alias("__bin"), F.lit(0).alias("__kind"), start.alias("__at"), end.alias("__end"), F.struct(*fields).alias("__span"))
    order = W.partitionBy("doc_id", "__bin").orderBy("__at", "__end")
    begins = begins.withColumn("__spans", F.array("__span", *[F.lag("__span", k).over(order) for k in range(1, deep)])).drop("__span")
    points = rows.select("doc_id", bin_of(start).alias("__bin"), F.lit(1).alias("__kind"), start.alias("__at"), F.struct(*rows.columns).alias("__row"))
    last = F.last("__spans", ignorenulls=True).over(W.partitionBy("doc_id", "__bin").orderBy("__at", "__kind", "__end").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = begins.unionByName(points, allowMissingColumns=True).withColumn("__last", last).filter("__kind = 1")
    return found.select("__row.*", F.filter("__last", lambda x: F.coalesce(x["end"] > F.col("__at"), F.lit(False))).alias("spans"))


def align(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans with the block they start in; blocks: (doc_id, start, end, ...) that don't overlap."""
    found = attached(spans, blocks.select("doc_id", "start", "end", F.col("elem_id").alias("block_id"), "page"))
    block = F.try_element_at("spans", F.lit(1))
    return found.select(*spans.columns, block["block_id"].alias("block_id"), block["page"].alias("page"))


def sentences(texts: DataFrame) -> DataFrame:
    """Sentences with their delimiters, from where the last one ended; blank ones fall out."""
    parts = texts.select("doc_id", F.posexplode(F.split("text", r"(?<=[。！？；.!?;])")).alias("part", "raw"))
    w = W.partitionBy("doc_id").orderBy("part")
    before = F.coalesce(F.sum(F.length("raw")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("start", before).withColumn("end", F.col("start") + F.length("raw")).withColumn("sentence", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).filter("sentence <> ''")
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("sent_no"), "sentence", "start", "end")


def in_spans(mentions: DataFrame, spans: DataFrame, number: str, deep: int = 1) -> DataFrame:
    """Mentions with the number of each span of their document that they start in; spans: (doc_id, number, start, end), of at most `deep` in a place."""
    found = attached(mentions, spans.select("doc_id", number, "start", "end"), deep)
    return found.select(*mentions.columns, F.explode(F.transform("spans", lambda x: x[number])).alias(number))


def sentence_relations(mentions: DataFrame, sentences_: DataFrame, patterns: Sequence[tuple[str, str]] = RELATION_PATTERNS, confidence: float = 0.8) -> DataFrame:
    """For every match of a pattern in a sentence with two mentions: a relation of its first two mentions."""
    rows = in_spans(mentions, sentences_, "sent_no")
    rank = F.row_number().over(W.partitionBy("doc_id", "sent_no").orderBy("pos"))
    firsts = rows.withColumn("n", rank).filter("n <= 2").groupBy("doc_id", "sent_no").agg(F.max(F.when(F.col("n") == 1, F.struct("text", "type", "start", "end"))).alias("head"), F.max(F.when(F.col("n") == 2, F.struct("text", "type", "start", "end"))).alias("tail")).filter("tail is not null")
    firsts = firsts.join(sentences_.select("doc_id", "sent_no", "sentence"), ["doc_id", "sent_no"])  # texts of sentences with two mentions alone
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("relation"), F.regexp_count("sentence", F.lit(f"(?iU){p}")).alias("times")) for i, (kind, p) in enumerate(patterns)])
    hits = firsts.select("*", F.explode(F.filter(rules, lambda r: r["times"] > 0)).alias("r")).select("*", F.posexplode(F.sequence(F.lit(1), F.col("r.times"))).alias("nth", "__i"))
    return hits.select("doc_id", F.col("head.text").alias("head"), F.col("head.type").alias("head_type"), F.col("tail.text").alias("tail"), F.col("tail.type").alias("tail_type"), F.col("r.relation").alias("relation"), F.lit(confidence).alias("confidence"), F.col("sentence").alias("evidence"), F.struct("sent_no", F.col("r.rule").alias("a"), F.col("nth").alias("b")).alias("at"), F.lit("sentence").alias("method"), F.lit(1).cast("long").alias("times"))


def sentence_windows(sentences_: DataFrame) -> DataFrame:
    """Every two neighbouring sentences: (doc_id, window, evidence, start, end)."""
    w = W.partitionBy("doc_id").orderBy("sent_no")
    rows = sentences_.withColumn("next", F.lead("sentence").over(w)).withColumn("w_end", F.lead("end").over(w)).filter("next is not null")
    return rows.select("doc_id", F.col("sent_no").alias("window"), F.concat_ws(" ", "sentence", "next").alias("evidence"), "start", F.col("w_end").alias("end"))


def window_pairs(mentions: DataFrame, windows: DataFrame, pairs: Sequence[tuple[str, str, str]] = TYPE_PAIRS) -> DataFrame:
    """The ordered pairs of mentions in a window whose types make a relation, counted by their texts: how many (times), and the first (h, t).

    No pair is a row, as their number grows with the square of a window's mentions: the places of two texts
    are put in one order, where the places of the tails say how many heads come before them."""
    inside = in_spans(mentions.select("doc_id", "start", "pos", "text", "type"), windows, "window", 2)
    places = inside.groupBy("doc_id", "window", "text", "type").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    kinds = mentions.sparkSession.createDataFrame(list(pairs), "head_type string, tail_type string, relation string")
    h = places.select("doc_id", "window", F.col("text").alias("head"), F.col("type").alias("head_type"), F.col("at").alias("heads")).join(F.broadcast(kinds), "head_type")
    t = places.select("doc_id", "window", F.col("text").alias("tail"), F.col("type").alias("tail_type"), F.col("at").alias("tails"))
    both = h.join(t, ["doc_id", "window", "tail_type"]).filter(F.element_at("heads", 1) < F.element_at("tails", -1))
    order = F.array_sort(F.concat(F.transform("tails", lambda x: F.struct(x.alias("at"), F.lit(0).alias("is_head"))), F.transform("heads", lambda x: F.struct(x.alias("at"), F.lit(1).alias("is_head")))))
    ranks = F.aggregate(F.transform(order, lambda x, i: F.when(x["is_head"] == 0, i).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size("tails").cast("long")
    first = F.array_min(F.filter("tails", lambda x: x > F.element_at("heads", 1)))
    return both.select("doc_id", "window", "head", "head_type", "tail", "tail_type", "relation", F.element_at("heads", 1).alias("h"), first.alias("t"), (ranks - F.shiftright(n * (n - 1), 1)).alias("times"))


def window_relations(mentions: DataFrame, sentences_: DataFrame, pairs: Sequence[tuple[str, str, str]] = TYPE_PAIRS, confidence: float = 0.6) -> DataFrame:
    """For every two neighbouring sentences: the ordered pairs of mentions whose types make a relation, a row for equal texts with how many `times` they stand there."""
    windows = sentence_windows(sentences_)
    rows = window_pairs(mentions, windows, pairs).join(windows.select("doc_id", "window", "evidence"), ["doc_id", "window"])
    return rows.select("doc_id", "head", "head_type", "tail", "tail_type", "relation", F.lit(confidence).alias("confidence"), "evidence", F.struct(F.col("window").alias("sent_no"), F.col("h").alias("a"), F.col("t").alias("b")).alias("at"), F.lit("window").alias("method"), "times")


def counted_evidence(relations: DataFrame) -> DataFrame:
    """Relations of one sentence or window have one evidence, so they are counted before anything is listed: m, place, evidence, lead, confidence, n."""
    method = F.when(F.col("method") == "sentence", 0).otherwise(1).alias("m")
    lead = F.min(F.struct("at", "head_type", "tail_type", "method")).alias("lead")
    return relations.groupBy("doc_id", "head", "relation", "tail", method, F.col("at.sent_no").alias("place"), "evidence").agg(lead, F.max("confidence").alias("confidence"), F.sum("times").alias("n"))


def aggregate_evidence(relations: DataFrame, least: float = 0.5) -> DataFrame:
    """One row of each (head, relation, tail) in a document: evidences in order, the highest confidence, their number.

    A list holds each text once, with how often it is to stand there. The text of all evidences has to be one
    string, of 2 GB at most; `evidence_digests` has no such limit."""
    keys = ["doc_id", "head", "relation", "tail"]
    order = F.struct("m", "lead.at")
    first = F.min_by(F.struct("lead.head_type", "lead.tail_type", "lead.method"), order).alias("first")
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "evidence", F.col("n").cast("int").alias("n"))))
    evidences = F.array_join(F.flatten(F.transform(listed, lambda x: F.array_repeat(x["evidence"], x["n"]))), " | ")
    rows = counted_evidence(relations).groupBy(*keys).agg(first, evidences.alias("evidence"), F.max("confidence").alias("confidence"), F.sum("n").alias("evidence_count"))
    return rows.filter(F.col("confidence") >= least).select("doc_id", "head", "first.head_type", "relation", "tail", "first.tail_type", "confidence", "evidence", "evidence_count", F.col("first.method").alias("method"))


def evidence_digests(relations: DataFrame, least: float = 0.5) -> DataFrame:
    """`aggregate_evidence` with the MD5 of the text of all evidences (evidence_md5) in place of the text, of any length.

    Sorted rows go by one after the other into the hash, each as often as it counts, so a task holds one evidence."""
    keys = ["doc_id", "head", "relation", "tail"]
    order = ["m", "at.sent_no", "at.a", "at.b"]
    rows = counted_evidence(relations).select(*keys, "m", "lead.*", "evidence", "confidence", "n")
    schema = rows.select(*keys, "head_type", "tail_type", "method", "confidence", F.col("n").alias("evidence_count"), F.lit("").alias("evidence_md5")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        types: list = []

        def groups() -> Iterator[tuple]:
            key, lead, most, count, digest, begun = None, None, None, 0, None, False
            for batch in batches:
                types[:] = [batch.schema.field(c).type for c in [*names[:8], "n"]] + [pa.string()]
                for *own, head_type, tail_type, method, confidence, evidence, n in zip(*[batch.column(c).to_pylist() for c in [*names[:8], "evidence", "n"]]):
                    if own != key:
                        if key is not None:
                            yield (*key, *lead, most, count, digest.hexdigest())
                        key, lead, most, count, digest, begun = own, (head_type, tail_type, method), confidence, 0, hashlib.md5(usedforsecurity=False), False
                    most, count = max(most, confidence), count + n
                    if evidence is None:
                        continue
                    raw = evidence.encode()
                    again = b" | " + raw
                    digest.update(again if begun else raw)
                    left, begun = n - 1, True
                    several = max(1, min(left, (1 << 20) // len(again)))
                    block = again * several
                    for _ in range(left // several):
                        digest.update(block)
                    digest.update(again * (left % several))
            if key is not None:
                yield (*key, *lead, most, count, digest.hexdigest())

        found = groups()
        while part := list(islice(found, HELD)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema).filter(F.col("confidence") >= least)


#: What a sentence ends with.
SENTENCE_END = re.compile(r"(?<=[。！？；.!?;])")


def _sentences_of(text: str, automaton, rows: Sequence[tuple]) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """Mentions (start, end, row of the term) of a text in order of places, and its sentences with the places of their first and last mention in these."""
    spans = sorted((last + 1 - len(rows[i][0]), last + 1, i) for last, i in automaton.iter(low(text))) if rows else []
    kept, end, at, n = [], 0, 0, len(spans)
    for raw in SENTENCE_END.split(text):
        end += len(raw)
        begin = at
        while at < n and spans[at][0] < end:
            at += 1
        if sentence := raw.strip(BLANKS):
            kept.append((sentence, begin, at))
    return spans, kept


#: Bytes that the digests of one share of a document hash, by a bound from above, and shares of a document at most.
HASHED, SHARES = 1 << 31, 32


def scan_sentences(texts: DataFrame, terms: Sequence[tuple]) -> DataFrame:
    """The `sentences` of texts, each with the mentions that start in it: (doc_id, sent_no, sentence, mentions, shares), in order of places.

    shares: into how many tasks the relations of the document are to be dealt, as evidences grow with the square of a sentence's mentions.

    `mentions` is a JSON array of a text and a type for each, as short strings are shuffled in less room than lists. A text and its mentions are in one task already, so neither is shuffled to find the other."""
    rows = [(str(t[0]).lower(), t[2]) for t in terms]
    names = ["doc_id", "sent_no", "sentence", "mentions", "shares"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rows)

        def found(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                spans, kept = _sentences_of(text, automaton, rows)
                hashed = sum((len(a[0]) + len(b[0])) * (b[2] - a[1]) ** 2 for a, b in zip(kept, kept[1:]))
                shares = min(SHARES, hashed // HASHED + 1)
                for number, (sentence, begin, at) in enumerate(kept):
                    yield doc, number, sentence, json.dumps([x for a, b, i in spans[begin:at] for x in (text[a:b], rows[i][1])], ensure_ascii=False, separators=(",", ":")), shares

        for batch in batches:
            yield from _held(found(batch), names, types)

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, sent_no int, sentence string, mentions string, shares int")


def scan_relation_counts(texts: DataFrame, terms: Sequence[tuple], pairs: Sequence[tuple[str, str, str]] = TYPE_PAIRS, confidence: float = 0.6) -> DataFrame:
    """How many evidences each relation of two neighbouring sentences has: (doc_id, head, relation, tail, confidence, evidence_count).

    As `scanned_digests`, for those who ask for numbers alone: a text's relations are counted where it is scanned, so only they
    are shuffled. A sentence's own pairs count once for each window that it is in."""
    rows = [(str(t[0]).lower(), t[2]) for t in terms]
    kinds = _kinds(pairs)
    names = ["doc_id", "head", "relation", "tail", "n"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rows)

        def found(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, kept = _sentences_of(text or "", automaton, rows)
                counts: dict[tuple, int] = {}
                before: dict[tuple[str, str], int] = {}
                for number, (_, begin, end) in enumerate(kept if len(kept) > 1 else ()):
                    mentions = [(text[a:b], rows[i][1]) for a, b, i in spans[begin:end]]
                    if len(mentions) > 1:
                        windows = (number > 0) + (number < len(kept) - 1)
                        for key, n in related(mentions, kinds).items():
                            counts[key] = counts.get(key, 0) + n * windows
                    times: dict[tuple[str, str], int] = {}
                    for m in mentions:
                        times[m] = times.get(m, 0) + 1
                    if before and times:
                        _crossed(counts, before, times, kinds)
                    before = times
                for (head, relation, tail, _, _), n in counts.items():
                    yield doc, head, relation, tail, n

        for batch in batches:
            yield from _held(found(batch), names, types)

    out = texts.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, head string, relation string, tail string, n long")
    return out.groupBy("doc_id", "head", "relation", "tail").agg(F.sum("n").alias("evidence_count")).withColumn("confidence", F.lit(confidence))


def _kinds(pairs: Sequence[tuple[str, str, str]]) -> dict[tuple[str, str], list[str]]:
    """Relations by the types of their ends."""
    out: dict[tuple[str, str], list[str]] = {}
    for head_type, tail_type, relation in pairs:
        out.setdefault((head_type, tail_type), []).append(relation)
    return out


def _crossed(counts: dict[tuple, int], heads: dict[tuple[str, str], int], tails: dict[tuple[str, str], int], kinds: dict[tuple[str, str], Sequence[str]]) -> None:
    """Add the pairs of the mentions of one sentence with those of a later one."""
    for head, n in heads.items():
        for tail, m in tails.items():
            for relation in kinds.get((head[1], tail[1]), ()):
                key = head[0], relation, tail[0], head[1], tail[1]
                counts[key] = counts.get(key, 0) + n * m


def related(mentions: Sequence[tuple[str, str]], kinds: dict[tuple[str, str], Sequence[str]]) -> dict[tuple, int]:
    """How often each (head, relation, tail, head_type, tail_type) stands in mentions (text, type) in their order. A mention is met by the texts before it, not by each of them."""
    out, before = {}, {}
    for tail in mentions:
        for head, n in before.items():
            for relation in kinds.get((head[1], tail[1]), ()):
                key = head[0], relation, tail[0], head[1], tail[1]
                out[key] = out.get(key, 0) + n
        before[tail] = before.get(tail, 0) + 1
    return out


class _Digest:
    """The evidences of one relation as they come: how many, and the MD5 of all their texts."""

    def __init__(self, head_type: str, tail_type: str):
        import hashlib

        self.ends, self.count, self.md5 = (head_type, tail_type), 0, hashlib.md5(usedforsecurity=False)

    def take(self, n: int, block: memoryview, size: int) -> None:
        """n times the same text; block: ` | ` and the text, repeated, of `size` each."""
        left = n
        if not self.count:
            self.md5.update(block[3:size])
            left -= 1
        several = len(block) // size
        for _ in range(left // several):
            self.md5.update(block)
        self.md5.update(block[: left % several * size])
        self.count += n


def scanned_digests(rows: DataFrame, pairs: Sequence[tuple[str, str, str]] = TYPE_PAIRS, confidence: float = 0.6, least: float = 0.5) -> DataFrame:
    """`evidence_digests` of `window_relations` for the rows of `scan_sentences`.

    The sentences of a document go by in their order. A window's pairs are those of each of its two sentences and
    those between them, so a sentence is sent once, and each digest takes its text as often as it counts.
    A task holds two sentences, and the digests of one document. A document of several `shares` is sent to as many
    tasks, each of which takes the relations that a hash gives it."""
    kinds = _kinds(pairs)
    names = ["doc_id", "head", "head_type", "relation", "tail", "tail_type", "confidence", "evidence_count", "evidence_md5", "method"]
    types = [pa.int64(), *[pa.string()] * 5, pa.float64(), pa.int64(), pa.string(), pa.string()]

    def first_ends(mentions: list[tuple[str, str]], key: tuple, found: dict) -> tuple[str, str]:
        """The types of the first pair of a relation, where its texts have several."""
        if len(found) == 1:
            return next(iter(found))
        tails = [(i, kind) for i, (text, kind) in enumerate(mentions) if text == key[2]]
        return next((kind, t) for i, (text, kind) in enumerate(mentions) if text == key[0] for j, t in tails if j > i and (kind, t) in found)

    def taken(digests: dict, counts: dict, mentions: list[tuple[str, str]], evidence: bytes, share: int, shares: int) -> None:
        by_key: dict[tuple, dict] = {}
        for (*key, head_type, tail_type), n in counts.items():
            if shares == 1 or zlib.crc32("\0".join(key).encode()) % shares == share:
                by_key.setdefault(tuple(key), {})[head_type, tail_type] = n
        again = b" | " + evidence
        most = max((sum(found.values()) for found in by_key.values()), default=0)
        size = len(again)
        block = memoryview(again * max(1, min(most, (1 << 20) // size)))
        for key, found in by_key.items():
            if key not in digests:
                digests[key] = _Digest(*first_ends(mentions, key, found))
            digests[key].take(sum(found.values()), block, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(at: tuple | None, digests: dict) -> Iterator[tuple]:
            for (head, relation, tail), x in digests.items():
                yield at[0], head, x.ends[0], relation, tail, x.ends[1], confidence, x.count, x.md5.hexdigest(), "window"

        def found() -> Iterator[tuple]:
            at, last, digests = None, None, {}
            for batch in batches:
                for doc, share, shares, listed, sentence in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "share", "shares", "mentions", "sentence")]):
                    if (doc, share) != at:
                        yield from closed(at, digests)
                        at, last, digests = (doc, share), None, {}
                    flat = json.loads(listed)
                    mentions = list(zip(flat[::2], flat[1::2]))
                    times: dict[tuple[str, str], int] = {}
                    for m in mentions:
                        times[m] = times.get(m, 0) + 1
                    here = related(mentions, kinds), times, mentions, sentence
                    if last is not None and (times or last[1]):
                        counts = dict(last[0])
                        for key, n in here[0].items():
                            counts[key] = counts.get(key, 0) + n
                        _crossed(counts, last[1], times, kinds)
                        if counts:
                            taken(digests, counts, last[2] + mentions, f"{last[3]} {sentence}".encode(), share, shares)
                    last = here
            yield from closed(at, digests)

        yield from _held(found(), names, types)

    asked = rows.filter("doc_id is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    out = asked.repartition("doc_id", "share").sortWithinPartitions("doc_id", "share", "sent_no").mapInArrow(run, "doc_id long, head string, head_type string, relation string, tail string, tail_type string, confidence double, evidence_count long, evidence_md5 string, method string")
    return out.filter(F.col("confidence") >= least)


def entity_ids(mentions: DataFrame, scope: str = "document") -> DataFrame:
    """(doc_id, text, id): the linked id or one of its place; the last mention of a text decides. scope: `document` puts the document into local ids, `shared` doesn't."""
    parts = ["doc_id"] if scope == "document" else []
    local = F.concat_ws("_", F.lit("local"), *parts, "start", "end")
    linked = F.col("linked_id") if "linked_id" in mentions.columns else F.lit(None).cast("string")
    return mentions.groupBy("doc_id", "text").agg(F.max_by(F.coalesce(linked, local), "pos").alias("id"), F.max_by("type", "pos").alias("type"), F.max_by("confidence", "pos").alias("confidence"))


def context(text: Column, start: Column, end: Column, width: int = 50) -> Column:
    left = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    return F.trim(F.concat_ws(" ", left, F.substring(text, end + 1, F.lit(width))))


def mention_input(text: Column, around: Column) -> Column:
    """What stands for a mention in the vectors: its text and its context."""
    return F.trim(F.concat_ws(" ", text, around))


def entry_input(name: Column, description: Column) -> Column:
    """What stands for an entry of the knowledge base: its name and description."""
    return F.trim(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))


def link(mentions: DataFrame, kb: DataFrame, k: int = 10) -> DataFrame:
    """Mentions (…, text, type, vector) with the best entry of kb (kb_id, name, aliases, type, kb_vector).

    Candidates share the type; the k nearest are blended with name and alias scores; a best one under
    NIL_SCORE is none. Whether it counts as linked hangs on its cosine alone."""
    entry = kb.select("kb_id", "name", "aliases", F.col("type").alias("kb_type"), "kb_vector")
    pairs = mentions.join(entry, F.col("type") == F.col("kb_type"), "left").withColumn("cos", cosine(F.col("vector"), F.col("kb_vector"))).drop("kb_vector", "kb_type")
    near = pairs.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "pos").orderBy(F.desc(F.round("cos", 9)), "kb_id"))).filter(F.col("n") <= k)
    within = lambda a, b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    string = lambda a, b: F.when(F.lower(a) == F.lower(b), 1.0).when(within(a, b), 0.8).otherwise(0.0)
    alias = F.coalesce(F.array_max(F.transform("aliases", lambda a: string(F.col("text"), a))), F.lit(0.0))
    blended = near.withColumn("final", 0.4 * F.col("cos") + 0.4 * string(F.col("text"), F.col("name")) + 0.2 * alias)
    # a mention is one group with its candidates, so it need not be joined with them again; vectors end before the shuffle where nothing asks for them
    best = F.max_by(F.struct("kb_id", "cos", "final"), F.when(F.col("final") >= NIL_SCORE, F.struct(F.round("final", 9), F.round("cos", 9)))).alias("best")
    rows = blended.groupBy("doc_id", "pos").agg(*[F.first(c).alias(c) for c in mentions.columns if c not in ("doc_id", "pos")], best)
    linked = F.coalesce(F.col("best.cos") >= LINK_SCORE, F.lit(False))
    return rows.select(*mentions.columns, "best").withColumn("linked_id", F.when(linked, F.col("best.kb_id"))).withColumn("linking_status", F.when(linked, "linked").otherwise("nil")).withColumn("link_score", F.col("best.final")).drop("best")


def link_entries(mentions: DataFrame, entries: Sequence[tuple], make: Callable = HashedEncoder, k: int = 10) -> DataFrame:
    """`link` for mentions (…, text, type, context) and a knowledge base (kb_id, name, aliases, type, description) that goes along with the plan.

    A mention is encoded with its context, compared with the entries of its type and done with in the task that has
    it, so vectors and candidates are no rows and nothing is shuffled. `context` ends here. make: as of `encoder`."""
    kept = [c for c in mentions.columns if c != "context"]
    added = [F.lit(None).cast(t).alias(c) for c, t in (("linked_id", "string"), ("linking_status", "string"), ("link_score", "double"))]
    schema = mentions.select(*kept, *added).schema
    string = lambda a, b: 1.0 if a == b else 0.8 if a in b or b in a else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by_type, blends = make(), {}, {}
        for entry in sorted(entries):
            by_type.setdefault(entry[3], []).append(entry)
        units = {kind: unit_vectors(model, [f"{e[1]} {e[4] or ''}".strip(" ") for e in own]) for kind, own in by_type.items()}

        def blend(text: str | None, kind: str) -> np.ndarray:
            """What names and aliases give to the score, for each entry of the type."""
            if text is None:
                return np.zeros((len(by_type[kind]), 2))
            if (text, kind) not in blends:
                if len(blends) >= HELD:
                    blends.clear()
                low_ = text.lower()
                blends[text, kind] = np.array([(0.4 * string(low_, e[1].lower()), 0.2 * max((string(low_, a.lower()) for a in e[2] or ()), default=0.0)) for e in by_type[kind]])
            return blends[text, kind]

        def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
            n = len(rows)
            ids, scores, cosines = np.full(n, None, object), np.full(n, np.nan), np.full(n, -1.0)
            texts, contexts, types = (rows.column(c).to_pylist() for c in ("text", "context", "type"))
            of_type: dict[str, list[int]] = {}
            for i, kind in enumerate(types):
                if kind in by_type:
                    of_type.setdefault(kind, []).append(i)
            for kind, at in of_type.items():
                x = unit_vectors(model, [f"{texts[i] or ''} {contexts[i] or ''}".strip(" ") for i in at])
                cos = np.zeros((len(at), len(by_type[kind])))
                for j in np.flatnonzero(units[kind].any(axis=0)):
                    cos += x[:, j, None] * units[kind][None, :, j]  # one component after the other, as equal sums decide ties
                of_text: dict[str | None, int] = {}
                which = [of_text.setdefault(texts[i], len(of_text)) for i in at]
                names = np.array([blend(t, kind) for t in of_text])[which]
                final = 0.4 * cos + names[:, :, 0] + names[:, :, 1]
                near = np.round(cos, 9)
                if near.shape[1] > k:  # entries are in order of their ids
                    order = np.argsort(-near, axis=1, kind="stable")[:, k:]
                    np.put_along_axis(final, order, -np.inf, axis=1)
                final[final < NIL_SCORE] = -np.inf
                best = np.lexsort((-near, -np.round(final, 9)), axis=1)[:, 0] if near.shape[1] > 1 else np.zeros(len(at), int)
                rows_ = np.arange(len(at))
                good = np.isfinite(final[rows_, best])
                places = np.array(at)[good]
                scores[places], cosines[places] = final[rows_, best][good], cos[rows_, best][good]
                ids[places] = [by_type[kind][b][0] for b in best[good]]
            link_ = cosines >= LINK_SCORE
            ids[~link_] = None
            new = [pa.array(ids, pa.string()), pa.array(np.where(link_, "linked", "nil"), pa.string()), pa.array(scores, pa.float64(), mask=np.isnan(scores))]
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *new], schema.names)

        for batch in batches:
            for at in range(0, len(batch), HELD):
                yield linked(batch.slice(at, HELD))

    return mentions.mapInArrow(run, schema)
