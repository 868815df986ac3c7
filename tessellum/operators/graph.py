"""The property graph: nodes (id, labels, type, text, document_id, …) and edges (src, rel_type, dst, …).

Upserts are mergeable aggregates; traversals are joins on edge tables, with a bounded number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions.text import containing
from tessellum.sources.scratch import written

MOST_DEPTH = 5


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """MERGE by id: of each property the last value that isn't null, in order of `version`; labels of all."""
    props = [c for c in rows.columns if c not in ("id", "labels", "version")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in props]
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), *last)


def upsert_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """MERGE by (src, rel_type, dst) among known nodes; of each property the last value that isn't null."""
    ids = nodes.select("id")
    known = rows.withColumn("rel_type", F.upper("rel_type")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    props = [c for c in rows.columns if c not in ("src", "dst", "rel_type", "version")]
    return known.groupBy("src", "rel_type", "dst").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in props])


def contains_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("document_id is not null").select(F.col("document_id").cast("string").alias("src"), F.lit("CONTAINS").alias("rel_type"), F.col("id").alias("dst"))


def document_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with the number of their entities and relations."""
    entities = nodes.groupBy("document_id").agg(F.count("*").alias("entity_count"))
    relations = edges.groupBy("document_id").agg(F.count("*").alias("relation_count"))
    return entities.join(relations, "document_id", "full").filter("document_id is not null").fillna(0)


def find_nodes(nodes: DataFrame, label: str | None = None, **properties) -> DataFrame:
    conditions = [F.array_contains("labels", label)] if label else []
    conditions += [F.col(k) == v for k, v in properties.items()]
    return nodes.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def find_edges(edges: DataFrame, nodes: DataFrame, rel_type: str | None = None, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    rows = edges if rel_type is None else edges.filter(F.col("rel_type") == rel_type)
    for end, label in (("src", src_label), ("dst", dst_label)):
        if label:
            rows = rows.join(find_nodes(nodes, label).select(F.col("id").alias(end)), end, "left_semi")
    return rows


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "rel_type").union(edges.select("dst", "src", "rel_type"))


def neighbours(edges: DataFrame, starts: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """Rows (id, neighbour) over edges of either direction, of the given types; starts: (id)."""
    rows = both_ways(edges if not rel_types else edges.filter(F.col("rel_type").isin(*rel_types)))
    return starts.select("id").join(rows, F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbour")).distinct()


#: Parts of the nodes that an anchor reaches, partitions of what is put together of them, and nodes of a list.
SALTS, DEALT, PACKED = 64, 256, 256


def leaves(rows: DataFrame) -> DataFrame:
    """Rows (leaf, hub): nodes of one neighbour, which has more, in edges of both directions (src, dst) without repetitions."""
    single = rows.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("hub")).filter("n = 1").select(F.col("src").alias("leaf"), "hub")
    return single.join(single.select(F.col("leaf").alias("hub")), "hub", "left_anti").select("leaf", "hub")


def distances(edges: DataFrame, starts: DataFrame, depth: int = MOST_DEPTH, ends: DataFrame | None = None) -> DataFrame:
    """Rows (start, end, hops) for every node that a path of at most so many edges joins to a start; starts: (start). ends: (end), the only ends asked for.

    No path goes through a leaf, a node of one neighbour, so only nodes that aren't leaves are walked over, from the
    starts or, for leaves, from their neighbours; all starts of one neighbour share its walk. Frontiers are expanded at once,
    and each is written before the next one is made, so every hop is one join of its own. A neighbour of a frontier lies in it, in the
    one before or in the next one, so only these two are taken out. The walk ends with an empty frontier. Then starts and ends
    of one anchor are put together by lists of PACKED, which are written: their number is that of the rows through PACKED twice,
    and the rows, which may be as many as the square of the nodes, are made of a list of starts and one of ends at a time. The ends of an
    anchor are dealt into parts, as few nodes may be the neighbours of all."""
    rows = written(both_ways(edges).select("src", "dst").filter("src <> dst").distinct(), "both-ways")
    single = written(leaves(rows), "leaves")
    inner = rows
    for end in ("src", "dst"):
        inner = inner.join(single.select(F.col("leaf").alias(end)), end, "left_anti")
    inner = written(inner.select("src", "dst"), "inner")
    placed = starts.select("start").distinct().join(single, F.col("start") == F.col("leaf"), "left")
    placed = written(placed.select("start", F.coalesce("hub", "start").alias("anchor"), F.when(F.col("hub").isNull(), 0).otherwise(1).alias("off")), "anchors")
    hops = [written(placed.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hops")).distinct(), "hop")]
    for hop in range(1, depth + 1):
        found = hops[-1].join(inner, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node")).distinct()
        for last in hops[-2:]:
            found = found.join(last.select("anchor", "node"), ["anchor", "node"], "left_anti")
        hops.append(written(found.withColumn("hops", F.lit(hop)), "hop"))
        if hops[-1].isEmpty():
            break
    reached = reduce(DataFrame.unionByName, hops)
    every = reached.select("anchor", F.col("node").alias("end"), "hops").unionByName(reached.join(single, F.col("node") == F.col("hub")).select("anchor", F.col("leaf").alias("end"), (F.col("hops") + 1).alias("hops")))
    if ends is not None:
        every = every.join(ends.select("end"), "end", "left_semi")
    every = every.filter(F.col("hops") <= depth).withColumn("salt", F.pmod(F.xxhash64("end"), F.lit(SALTS)).cast("int")).repartition(DEALT, "anchor", "salt")
    ends_ = _packed(every, ["anchor", "hops", "salt"], "end")
    starts_ = _packed(placed, ["anchor", "off"], "start").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hops_ = F.col("hops") + F.col("off")
    both = written(ends_.join(starts_, ["anchor", "salt"]).filter(hops_.between(1, depth)).select("start", "end", hops_.alias("hops")), "packs")
    rows = both.select(F.explode("start").alias("start"), "end", "hops").select("start", F.explode("end").alias("end"), "hops")
    return rows.filter(F.col("start") != F.col("end"))


def _packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of each keys with lists of up to PACKED of a column."""
    block = F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(name)) - 1) / PACKED)
    return rows.withColumn("__block", block).groupBy(*keys, "__block").agg(F.collect_list(name).alias(name)).drop("__block")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """Rows (start, end, hops) for the pairs (start, end) of distinct nodes that some path of at most so many edges joins.

    Paths go either way along edges, so the walk begins at the side of the pairs that has fewer nodes."""
    asked = written(pairs.filter("start <> end").distinct(), "pairs")
    counts = asked.agg(F.countDistinct("start"), F.countDistinct("end")).first()
    if counts[0] <= counts[1]:
        return asked.join(distances(edges, asked, depth), ["start", "end"])
    back = distances(edges, asked.select(F.col("end").alias("start")), depth).select(F.col("start").alias("end"), F.col("end").alias("start"), "hops")
    return asked.join(back, ["start", "end"])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"), F.array_sort(F.collect_set("rel_type")).alias("rel_types")))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DETACH DELETE of (id): nodes that stay, and edges whose two ends do."""
    stay = nodes.join(gone.select("id"), "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return stay, edges


def delete_document(nodes: DataFrame, edges: DataFrame, document_id) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.filter(F.col("document_id") == document_id).select("id"))


def created_edge(edges: DataFrame, nodes: DataFrame, src: str, rel_type: str, dst: str, **properties) -> DataFrame:
    """edges with one more between two nodes by their ids; without either node they stay as they are."""
    ends = nodes.filter(F.col("id").isin(src, dst)).agg(F.countDistinct("id").alias("n")).filter(F.col("n") == len({src, dst}))
    return edges.unionByName(ends.select(F.lit(src).alias("src"), F.lit(rel_type.upper()).alias("rel_type"), F.lit(dst).alias("dst"), *[F.lit(v).alias(k) for k, v in properties.items()]), allowMissingColumns=True)


def updated_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the properties of changes (id, ...) that aren't null set over their own; other ids count for nothing."""
    props = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in props]).join(nodes.select("id"), "id", "left_semi")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in props else F.col(c) for c in nodes.columns]
    return nodes.join(new, "id", "left").select(*kept, *[F.col(f"__{c}").alias(c) for c in props if c not in nodes.columns])


def cleared(rows: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return rows.limit(0)


def search_names(nodes: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """Rows (word, id): the first nodes, by id, whose name contains a word. words: (word)."""
    hits = containing(nodes.select("id", "text"), "text", words.select("word").distinct(), "word").select("word", "id")
    return top_ids(hits, ["word"], limit)


def top_ids(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first distinct ids of each key; every partition is cut to so many before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return hits.select(*keys, "id").distinct().withColumn("__n", rank).filter(F.col("__n") <= limit).drop("__n")


def recall(queries: DataFrame, nodes: DataFrame, edges: DataFrame, relations: int = 5, entities: int = 3) -> DataFrame:
    """Hits (query_id, kind, name, id, score) for names (query_id, name).

    Each name brings its first relations; if no name of a query has any, each brings its first entities."""
    asked = queries.select("query_id", "name").distinct()
    named = containing(nodes.select("id", "text"), "text", asked.select("name").distinct(), "name").select("name", F.col("id").alias("node"))
    key = F.concat_ws("|", "src", "rel_type", "dst").alias("id")
    ends = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    touching = [ends.join(named, F.col(end) == F.col("node")).select("name", key) for end in ("src", "dst")]
    firsts = top_ids(touching[0].union(touching[1]), ["name"], relations)
    related = asked.join(firsts, "name").select("query_id", "name", "id", F.lit("graph").alias("kind"), F.lit(0.8).alias("score"))
    single = asked.join(top_ids(named.select("name", F.col("node").alias("id")), ["name"], entities), "name").select("query_id", "name", "id", F.lit("graph_entity").alias("kind"), F.lit(0.6).alias("score"))
    return related.unionByName(single.join(related.select("query_id").distinct(), "query_id", "left_anti"))
