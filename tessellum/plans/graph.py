"""Queries on the property graph, over the star schema as a graph of places and parties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import graph as G
from tessellum.operators import paths as P
from tessellum.operators.names import NameIndex, add_names, search_substring
from tessellum.sources.fixtures import table
from tessellum.sources.scratch import fresh_path


def _graph(spark, sf_dir):
    """Regions, nations, suppliers and customers with the edges between them."""
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    node = lambda df, prefix, key, name, label, doc: df.select(F.concat(F.lit(prefix), key).alias("id"), F.array(F.lit("Place" if label in ("Region", "Nation") else "Party"), F.lit(label)).alias("labels"), F.col(name).alias("text"), (doc if doc is not None else F.lit(None).cast("long")).alias("document_id"))
    nodes = node(region, "r", "r_regionkey", "r_name", "Region", None).unionByName(node(nation, "n", "n_nationkey", "n_name", "Nation", F.col("n_regionkey").cast("long"))).unionByName(node(supplier, "s", "s_suppkey", "s_name", "Supplier", F.col("s_nationkey").cast("long"))).unionByName(node(customer, "c", "c_custkey", "c_name", "Customer", F.col("c_nationkey").cast("long")))
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("src"), F.lit(kind).alias("rel_type"), F.concat(F.lit(b), y).alias("dst"), F.col(y).cast("long").alias("document_id"))
    edges = edge(nation, "n", "n_nationkey", "r", "n_regionkey", "PART_OF").unionByName(edge(supplier, "s", "s_suppkey", "n", "s_nationkey", "BASED_IN")).unionByName(edge(customer, "c", "c_custkey", "n", "c_nationkey", "LIVES_IN"))
    return nodes, edges


def graph_statistics(spark, sf_dir):
    return G.statistics(*_graph(spark, sf_dir)).select("nodes", F.array_join("labels", ",").alias("labels"), "edges", F.array_join("rel_types", ",").alias("rel_types"))


def graph_upsert_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.array("event_type").alias("labels"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("props"), F.col("event_id").alias("version"))
    return G.upsert_nodes(rows).select("id", F.array_join("labels", ",").alias("labels"), "value", "props")


def graph_upsert_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey")))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("flag_"), F.lower("l_returnflag")).alias("rel_type"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("version"), "l_quantity")
    return G.upsert_edges(rows, nodes)


def graph_document_counts(spark, sf_dir):
    return G.document_nodes(*_graph(spark, sf_dir))


def graph_contains(spark, sf_dir):
    return G.contains_edges(_graph(spark, sf_dir)[0])


def graph_find(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.find_edges(edges, nodes, "BASED_IN", "Supplier", "Nation").join(G.find_nodes(nodes, "Place", document_id=1).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type")


def graph_neighbours(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.neighbours(edges, G.find_nodes(nodes, "Nation"), ["BASED_IN", "PART_OF"])


def graph_shortest_paths(spark, sf_dir):
    """Paths between a stated set, the suppliers whose number is divisible by 50, and all customers."""
    _, edges = _graph(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").filter("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("end"))
    return G.distances(edges, asked, ends=customers)


def graph_distances(spark, sf_dir):
    """The distance of all nodes from a stated set of starts: the nodes whose number is divisible by 50."""
    nodes, edges = _graph(spark, sf_dir)
    return G.distances(edges, nodes.filter("cast(substring(id, 2) as long) % 50 = 0").select(F.col("id").alias("start")))


def graph_paths(spark, sf_dir):
    """The path between each customer and supplier that traded in one order, for the suppliers whose number is divisible by 50."""
    _, edges = _graph(spark, sf_dir)
    traded = table(spark, sf_dir, "lineitem").filter("l_suppkey % 50 = 0").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = traded.select(F.concat(F.lit("s"), "l_suppkey").alias("start"), F.concat(F.lit("c"), "o_custkey").alias("end")).distinct()
    return P.shortest_path_rows(edges, pairs).select("start", "end", "hops", F.array_join("nodes", "/").alias("nodes"), F.array_join("vias", "/").alias("vias"))


def graph_pattern_one_hop(spark, sf_dir):
    """(a:Supplier)-[:BASED_IN]->(b:Nation {document_id: 2})"""
    nodes, edges = _graph(spark, sf_dir)
    return P.match(nodes, edges, P.Node("a", "Supplier"), P.Edge(["BASED_IN"]), P.Node("b", "Nation", {"document_id": 2}))


def graph_pattern_two_hops(spark, sf_dir):
    """(a:Supplier)-[:BASED_IN]->(b)-[:PART_OF]->(c:Region) where the region's name begins with A"""
    nodes, edges = _graph(spark, sf_dir)
    return P.match(nodes, edges, P.Node("a", "Supplier"), P.Edge(["BASED_IN"]), P.Node("b"), P.Edge(["PART_OF"]), P.Node("c", "Region", where=F.startswith("text", F.lit("A"))))


def graph_pattern_any_way(spark, sf_dir):
    """(a:Supplier)-[]-(b:Nation)-[:LIVES_IN]-(c:Customer) where both numbers are divisible by 25"""
    nodes, edges = _graph(spark, sf_dir)
    fits = F.expr("cast(substring(id, 2) as long) % 25 = 0")
    return P.match(nodes, edges, P.Node("a", "Supplier", where=fits), P.Edge(direction="any"), P.Node("b", "Nation"), P.Edge(["LIVES_IN"], "in"), P.Node("c", "Customer", where=fits))


def graph_delete_document(spark, sf_dir):
    nodes, edges = G.delete_document(*_graph(spark, sf_dir), 3)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def graph_name_search(spark, sf_dir):
    words = spark.createDataFrame([("1",), ("2",), ("zzz",)], "word string")
    return G.search_names(_graph(spark, sf_dir)[0], words, 5)


def name_index_hits(spark, sf_dir):
    """How many names have the last four characters of each supplier's, from a stored index that is made in two additions."""
    nodes = _graph(spark, sf_dir)[0].select("id", "text")
    index = NameIndex(spark, fresh_path(spark, "names"))
    add_names(index, nodes.filter("id not like 'c%'"))
    add_names(index, nodes.filter("id like 'c%'"))
    patterns = table(spark, sf_dir, "supplier").select(F.substring("s_name", -4, 4).alias("pattern"))
    return search_substring(index, patterns).groupBy("pattern").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def graph_recall(spark, sf_dir):
    """Relations for the first letters of the names of nations and regions, over the whole graph."""
    nodes, edges = _graph(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 4).alias("name")).union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + 100, F.substring("r_name", 1, 4)))
    return G.recall(names, nodes, edges)


def graph_updated(spark, sf_dir):
    """The graph after one more edge and new properties of some nodes: what nodes and edges it has by kind."""
    nodes, edges = _graph(spark, sf_dir)
    changes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.upper("n_name").alias("text"), F.length("n_name").alias("size"))
    more = G.updated_nodes(nodes, changes.unionByName(spark.createDataFrame([("none", "x", 1)], changes.schema)))
    edges = G.created_edge(edges, nodes, "r0", "beside", "r1", document_id=0)
    edges = G.created_edge(edges, nodes, "r0", "beside", "nowhere", document_id=0)
    kinds = more.select(F.element_at("labels", -1).alias("kind"), F.when(F.col("text") == F.upper("text"), 1).otherwise(0).alias("upper"), "size").groupBy("kind").agg(F.count("*").alias("n"), F.sum("upper").alias("uppers"), F.sum("size").alias("sizes"))
    return kinds.unionByName(edges.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")), allowMissingColumns=True).unionByName(G.cleared(kinds))


QUERIES = {f.__name__: f for f in (graph_statistics, graph_upsert_nodes, graph_upsert_edges, graph_document_counts, graph_contains, graph_find, graph_neighbours, graph_shortest_paths, graph_distances, graph_delete_document, graph_name_search, name_index_hits, graph_recall, graph_updated, graph_paths, graph_pattern_one_hop, graph_pattern_two_hops, graph_pattern_any_way)}

_G = """with nodes as (
  select 'r' || r_regionkey as id, ['Place', 'Region'] as labels, r_name as text, cast(null as bigint) as document_id from region
  union all select 'n' || n_nationkey, ['Place', 'Nation'], n_name, n_regionkey from nation union all select 's' || s_suppkey, ['Party', 'Supplier'], s_name, s_nationkey from supplier union all select 'c' || c_custkey, ['Party', 'Customer'], c_name, c_nationkey from customer),
edges as (
  select 'n' || n_nationkey as src, 'PART_OF' as rel_type, 'r' || n_regionkey as dst, cast(n_regionkey as bigint) as document_id from nation
  union all select 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey, s_nationkey from supplier union all select 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey, c_nationkey from customer),
both_ways as (select src, dst, rel_type from edges union all select dst, src, rel_type from edges)"""

ORACLES = {
    "graph_statistics": _G + " select (select count(*) from nodes) as nodes, (select array_to_string(list_sort(list(distinct l)), ',') from (select unnest(labels) as l from nodes)) as labels, (select count(*) from edges) as edges, (select array_to_string(list_sort(list(distinct rel_type)), ',') from edges) as rel_types",
    "graph_upsert_nodes": "select user_id as id, array_to_string(list_sort(list(distinct event_type)), ',') as labels, arg_max(value, event_id) filter (event_type <> 'view' and value is not null) as value, arg_max(props, event_id) filter (props is not null) as props from events group by user_id",
    "graph_upsert_edges": "select 's' || l_suppkey as src, upper('flag_' || l_returnflag) as rel_type, 'p' || l_partkey as dst, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as l_quantity from lineitem where l_suppkey in (select s_suppkey from supplier) and l_partkey in (select p_partkey from part) group by all",
    "graph_document_counts": _G + ", a as (select document_id, count(*) as n from nodes group by 1), b as (select document_id, count(*) as n from edges group by 1) select document_id, coalesce(a.n, 0) as entity_count, coalesce(b.n, 0) as relation_count from a full join b using (document_id) where document_id is not null",
    "graph_contains": _G + " select cast(document_id as varchar) as src, 'CONTAINS' as rel_type, id as dst from nodes where document_id is not null",
    "graph_find": _G + " select src, dst, rel_type from edges where rel_type = 'BASED_IN' and dst in (select id from nodes where list_contains(labels, 'Place') and document_id = 1)",
    "graph_neighbours": _G + " select distinct src as id, dst as neighbour from both_ways where rel_type in ('BASED_IN', 'PART_OF') and src like 'n%'",
    "graph_shortest_paths": "select 's' || s_suppkey as start, 'c' || c_custkey as \"end\", case when s_nationkey = c_nationkey then 2 else 4 end as hops from supplier join nation a on a.n_nationkey = s_nationkey, customer join nation b on b.n_nationkey = c_nationkey where s_suppkey % 50 = 0 and (s_nationkey = c_nationkey or a.n_regionkey = b.n_regionkey)",
    "graph_distances": _G.replace("with nodes", "with recursive nodes")
    + """, walk(start, node, hops) as (select id, id, 0 from nodes where cast(id[2:] as bigint) % 50 = 0 union select start, dst, hops + 1 from walk join both_ways on src = node where hops < 5)
select start, node as "end", cast(min(hops) as int) as hops from walk where start <> node group by start, node""",
    "graph_delete_document": _G + ", gone as (select id from nodes where document_id = 3) select (select count(*) from nodes where id not in (from gone)) as nodes, (select count(*) from edges where src not in (from gone) and dst not in (from gone)) as edges",
    "graph_name_search": _G + ", w(word) as (values ('1'), ('2'), ('zzz')) select word, id from w join nodes on contains(text, word) qualify row_number() over (partition by word order by id) <= 5",
    "name_index_hits": _G + ", p as (select distinct right(s_name, 4) as pattern from supplier) select pattern, count(*) as n, max(id) as last_id from p join nodes on contains(text, pattern) group by 1",
    "graph_recall": _G
    + """, e as (select e.src || '|' || rel_type || '|' || e.dst as id, h.text as head, t.text as tail from edges e join nodes h on h.id = e.src join nodes t on t.id = e.dst),
names as (select n_nationkey as query_id, n_name[1:4] as name from nation union all select r_regionkey + 100, r_name[1:4] from region),
rel as (select query_id, name, id, 'graph' as kind, cast(0.8 as double) as score from names join e on contains(head, name) or contains(tail, name) qualify row_number() over (partition by query_id, name order by id) <= 5),
ent as (select query_id, name, id, 'graph_entity' as kind, cast(0.6 as double) as score from names join nodes on contains(text, name) where query_id not in (select query_id from rel) qualify row_number() over (partition by query_id, name order by id) <= 3)
select * from rel union all select * from ent""",
    "graph_paths": _G.replace("with nodes", "with recursive nodes")
    + """, pairs as (select distinct 's' || l_suppkey as a, 'c' || o_custkey as z from lineitem join orders on l_orderkey = o_orderkey where l_suppkey % 50 = 0),
ways as (select src, dst, min(via) as via from (select src, dst, '>' || rel_type as via from edges union all select dst, src, '<' || rel_type from edges) group by src, dst),
walk(a, node, hops, nodes, vias) as (
  select distinct a, a, 0, [a], cast([] as varchar[]) from pairs
  union all select a, dst, hops + 1, list_append(nodes, dst), list_append(vias, via) from walk join ways on src = node where hops < 5 and not list_contains(nodes, dst))
select a as start, z as "end", cast(hops as int) as hops, array_to_string(nodes, '/') as nodes, array_to_string(vias, '/') as vias
from walk join pairs using (a) where node = z qualify row_number() over (partition by a, z order by hops, walk.nodes, walk.vias) = 1""",
    "graph_pattern_one_hop": _G + " select e.src as a, e.dst as b, rel_type as rel_1 from edges e join nodes b on b.id = e.dst where rel_type = 'BASED_IN' and list_contains(b.labels, 'Nation') and b.document_id = 2",
    "graph_pattern_two_hops": _G + " select e.src as a, e.dst as b, f.dst as c, e.rel_type as rel_1, f.rel_type as rel_2 from edges e join edges f on f.src = e.dst join nodes c on c.id = f.dst where e.rel_type = 'BASED_IN' and f.rel_type = 'PART_OF' and starts_with(c.text, 'A')",
    "graph_pattern_any_way": _G + " select e.src as a, e.dst as b, f.src as c, e.rel_type as rel_1, f.rel_type as rel_2 from edges e join edges f on f.dst = e.dst where e.rel_type = 'BASED_IN' and f.rel_type = 'LIVES_IN' and cast(e.src[2:] as bigint) % 25 = 0 and cast(f.src[2:] as bigint) % 25 = 0",
    "graph_updated": _G
    + """, n2 as (select labels[-1] as kind, case when labels[-1] = 'Nation' then upper(text) else text end as text, case when labels[-1] = 'Nation' then length(text) end as size from nodes)
select kind, count(*) as n, sum((text = upper(text))::int) as uppers, sum(size) as sizes from n2 group by kind
union all select rel_type, count(*), null, null from (select rel_type from edges union all select 'BESIDE') group by rel_type""",
}
