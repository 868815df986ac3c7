"""Hand-made cases for semantics that the fixtures don't reach."""

import math

import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as X
from tessellum.operators import answer as A
from tessellum.operators import extraction as E
from tessellum.operators import graph as G
from tessellum.operators import relational as R
from tessellum.operators import retrieval as Q
from tessellum.operators import structure as S
from tessellum.sources.fixtures import status_events
from tessellum.streaming import status


def value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


LEXICON = [("cho", "cho", "CellLine", 1), ("cho-k1", "cho-k1", "CellLine", 1), ("hcp", "hcp", "Protein", 2), ("ab", "ab", "Protein", 2), ("试剂", "试剂", "Reagent", 3), ("试剂盒", "试剂盒", "Product", 4), ("kit", "kit", "Product", 4)]


def test_scan_and_resolve(spark):
    texts = spark.createDataFrame([(1, "CHO-K1 produces HCP"), (2, "HCP试剂盒kit"), (3, "available"), (4, "x ab试剂ab"), (5, None), (6, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["end"], r["canonical"]) for r in E.resolve(E.scan(texts, LEXICON)).collect())
    assert got == [(1, 0, 3, "cho"), (1, 16, 19, "hcp"), (2, 0, 3, "hcp"), (2, 3, 5, "试剂"), (2, 6, 9, "kit"), (3, 5, 7, "ab"), (4, 2, 4, "ab"), (4, 4, 6, "试剂"), (4, 6, 8, "ab")]
    spans = lambda df: sorted(tuple(r) for r in df.collect())
    assert spans(E.scan_columns(texts, LEXICON)) == spans(E.scan(texts, LEXICON))


def test_resolve_is_the_fold(spark):
    import random

    rng = random.Random(2)
    rows = [(d, s, s + rng.randrange(1, 6), f"t{i}", f"c{i}", "T", rng.randrange(1, 4)) for d in range(20) for i, s in enumerate(rng.randrange(40) for _ in range(rng.randrange(1, 12)))]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, canonical string, type string, priority int")
    want = []
    for d in range(20):
        mine = sorted((r[1], r[2], r[6], r[3], r[4]) for r in rows if r[0] == d)
        while mine:
            group = [m for m in mine if m[0] < mine[0][1]]
            best = min(group, key=lambda m: m[2])
            want.append((d, best[0], best[1], best[4]))
            mine = mine[len(group) :]
    got = [(r["doc_id"], r["start"], r["end"], r["canonical"]) for r in E.resolve(df).orderBy("doc_id", "pos").collect()]
    assert got == want


def test_sentences(spark):
    got = E.sentences(spark.createDataFrame([(1, "A v2.1 x。 B!  "), (2, ""), (3, None), (4, "no end")], "doc_id long, text string")).orderBy("doc_id", "sent_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "A v2.", 0, 5), (1, 1, "1 x。", 5, 9), (1, 2, "B!", 9, 12), (4, 0, "no end", 0, 6)]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("  请 查询 ＣＨＯ－Ｋ１细胞的 Host Cell Protein  ", "CHOK1细胞的 HCP"), ("帮我 查询", "帮我 查询"), ("宿主细胞蛋白ELISA检测", "HCP ELISA 检测"),
    ],
)
def test_normalise_query(spark, query, want):
    assert value(spark, X.normalise_query(F.col("q")), q=query) == want


def test_text_functions(spark):
    assert value(spark, X.strip(F.col("q")), q="　 a b \n") == "a b"
    assert [value(spark, X.timeout_seconds(F.col("q")), q=q) for q in ("60", "60s", "1.5m", "1h", "x", "")] == [60, 60, 90, 3600, 60, 60]
    assert [value(spark, X.safe_name(F.col("q")), q=q) for q in ("a/b:c.pdf", " .x. ", "", "...", "n" * 300 + ".pdf")] == ["a_b_c.pdf", "x", "unknown", "unknown_file", "n" * 196 + ".pdf"]
    assert value(spark, X.tokens(F.col("q")), q="The 细胞 v2.1 is Élan") == ["细", "胞", "v2", "1", "élan"]
    assert value(spark, X.fold_width(F.col("q")), q="ＣＨＯ－Ｋ１") == "CHO-K1"
    assert value(spark, X.query_entities(F.col("q"))["product_model"], q="kit AB123 and cho-1 v2.0") == ["AB123", "cho-1", "v2.0"]
    assert "Host Cell Protein" in value(spark, X.expand(F.array(F.col("q"))), q="HCP")
    raw = spark.createDataFrame([("é".encode(),), ("中文".encode("gbk"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(X.decoded("b")).collect()] == ["é", "中文", None]
    assert value(spark, X.title_similarity(F.col("q")), q="HCP") == pytest.approx(1 / 17 + 0.1)
    assert [value(spark, A.document_of(F.col("q")), q=q) for q in ("d_doc#2024-01-01#7_0009", "plain")] == [7, None]
    assert [value(spark, A.image_url(F.col("q")), q=q) for q in ("http://x", "/y", "figures/z", "")] == ["http://x", "/y", "/static/uploads/figures/z", ""]
    assert value(spark, A.reference_line(F.lit(1), F.col("n"), F.col("t"), F.array(F.lit(2), F.lit(1)), F.array(F.lit("image"), F.lit("image"), F.lit("table"))), n="doc", t="sec") == "[1] doc - sec 第1, 2页 (包含2个图片, 1个表格)"


def test_self_weighted(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0), (3, 0.0), (3, 0.0), (4, None)], "k int, s double")
    got = {r["k"]: r["v"] for r in rows.groupBy("k").agg(Q.self_weighted(F.col("s")).alias("v")).collect()}
    assert got == {1: 2.0, 2: 2.5, 3: 0.0, 4: 0.0}


@pytest.mark.parametrize(("intent", "fused", "final"), [("fragment", 1.9, 1.825), ("title", 2.7, 2.21)])
def test_fusion_and_rerank(spark, intent, fused, final):
    kind = "title" if intent == "title" else "fragment"
    hits = [(1, intent, "s", "d", "e1", "alpha here", "alpha beta", "fragment", 1, 4.0, "bm25", 1), (1, intent, "s", "d", "e2", "alpha here", "x", kind, 2, 0.5, "vector", 2), (1, intent, None, "d", "e3", "t", "x", kind, 2, 9.0, "bm25", 3), (1, intent, "s", "d", "e4", "t", "x", "entity", 2, 0.6, "graph_entity", 4)]
    df = spark.createDataFrame(hits, "query_id int, intent string, section_id string, doc_id string, element_id string, title string, content string, content_type string, page int, score double, source string, arrival int")
    rows = Q.fuse(df)
    assert rows.first()["final_score"] == pytest.approx(fused)
    best = Q.rerank(rows, spark.createDataFrame([(1, "Alpha beta")], "query_id int, query string")).first()
    assert best["final_score"] == pytest.approx(final)
    assert best["evidence"]["element_id"] == "e1"


def test_merge_adjacent(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2, "ab", "P", 0.8), (1, 1, 2, 4, "cd", "P", 0.7), (1, 2, 4, 6, "ef", "Q", 0.8), (1, 3, 6, 8, "gh", "P", 0.8)], "doc_id long, pos int, start int, end int, text string, type string, confidence double")
    got = [(r["start"], r["end"], r["text"], r["type"], r["confidence"]) for r in E.merge_adjacent(spans).orderBy("start").collect()]
    assert got == [(0, 4, "abcd", "P", 0.7), (4, 6, "ef", "Q", 0.8), (6, 8, "gh", "P", 0.8)]


def test_pattern_entities_and_relations(spark):
    texts = spark.createDataFrame([(1, "CHO-K1 produces HCP. The kit detects hcp here."), (2, "one sentence HCP 抗体")], "doc_id long, text string")
    found = E.distinct_spans(E.pattern_entities(texts))
    assert {(r["doc_id"], r["text"], r["type"]) for r in found.collect()} >= {(1, "CHO-K1", "CellLine"), (1, "HCP", "Protein"), (1, "kit", "Product"), (1, "hcp", "Protein")}
    mentions = E.merge_with_anchors(E.resolve(E.scan(texts, LEXICON)), found)
    sents = E.sentences(texts)
    by_pattern = E.sentence_relations(mentions, sents)
    assert {(r["head"], r["relation"], r["tail"]) for r in by_pattern.collect()} == {("CHO", "produces", "HCP")}
    windows = E.window_relations(mentions, sents)
    rows = {(r["doc_id"], r["head"], r["relation"], r["tail"]) for r in windows.collect()}
    assert (1, "CHO", "produces", "HCP") in rows and not any(r[0] == 2 for r in rows)  # one sentence makes no window
    merged = E.aggregate_evidence(by_pattern.unionByName(windows)).filter("head = 'CHO' and tail = 'HCP'").first()
    assert merged["confidence"] == 0.8 and merged["evidence_count"] == 2 and merged["method"] == "sentence" and merged["evidence"].count(" | ") == 1


def test_lexicon(spark):
    entries = spark.createDataFrame([(1, "CHO", "CellLine", ["Ｃ１"]), (2, "cho", "Protein", None)], "ord int, canonical string, type string, aliases array<string>")
    assert {(r["term"], r["canonical"], r["priority"]) for r in E.lexicon(entries).collect()} == {("cho", "cho", 2), ("ｃ１", "CHO", 1), ("c1", "CHO", 1)}


def test_sections_and_blocks(spark):
    rows = [(1, 0, "Text", "intro", 1, None, None), (1, 1, "Title", " Head ", 2, None, None), (1, 2, "Text", "x", 3, [(1.9, 2.2), (5.0, 6.0), (7.5, 8.5)], None), (1, 3, "Table", "a | b\n\n c | d ", 2, None, "<table class='k'><tr><th>a</th><th>b</th></tr></table>"), (1, 4, "Image", "cap", None, None, None), (1, 5, "Text", " 　", 9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, elem_index int, elem_type string, text string, page int, points array<struct<x:double,y:double>>, text_as_html string")
    blocks = S.blocks(df)
    got = [(r["section_no"], r["title"], r["page_start"], r["page_end"], r["full_text"]) for r in S.sections(blocks).orderBy("section_no").collect()]
    assert got == [(1, "文档内容", 1, 1, "intro"), (2, "Head", 1, 3, "Head\nx\na | b\n\n c | d\ncap")]
    by = {r["elem_id"]: r for r in blocks.filter("section_no = 2").collect()}
    assert set(by) == {"title_t1", "para_p2", "tbl_3", "fig_4"}
    assert by["para_p2"]["bbox"] == [[1, 2], [7, 8]] and by["title_t1"]["bbox"] == [[0, 0], [0, 0]]
    assert [tuple(x) for x in by["tbl_3"]["rows"]] == [("tbl_3_r1", "a | b"), ("tbl_3_r3", "c | d")]
    assert by["tbl_3"]["html"] == '<table class="multimodal-table k"><tr><th>a</th><th>b</th></tr></table>'
    head = S.table_heads(blocks).first()
    assert (head["n_rows"], head["n_cols"], head["n_cols_html"]) == (2, 2, 2)
    figure = S.figure_rows(blocks).first()
    assert figure["caption"] == "cap" and figure["bbox_norm"]["x1"] == 0.0 and figure["page"] == 1
    assert value(spark, S.row_text(F.create_map(F.lit("row_text"), F.lit("z"), F.lit("k"), F.lit("v"), F.lit("e"), F.lit("")))) == "k: v"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("1", "alpha", "alpha beta", ""), ("2", "", "beta beta gamma", ""), ("3", "", "delta", "")], "_id string, title string, content string, summary string")
    row = {r["_id"]: r["score"] for r in Q.bm25(spark.createDataFrame([(1, "alpha")], "query_id int, query string"), docs).collect()}
    weight = lambda n, df, tf, dl, avg: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    title, content = weight(1, 1, 1, 1, 1), weight(3, 1, 1, 2, 2)
    assert set(row) == {"1"}
    assert row["1"] == pytest.approx(2 * max(3 * title, content) + 1.5 * max(3 * title, 1.5 * content))


def test_vector_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(str(i), [math.cos(i), math.sin(i)], "title" if i % 2 else "fragment") for i in range(50)], "id string, vector array<double>, content_type string")
    asked = spark.createDataFrame([(i, [math.cos(i * 0.3), math.sin(i * 0.3)]) for i in range(7)], "query_id int, query_vector array<double>")
    whole = sorted(map(tuple, Q.vector_top(asked, vectors, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(Q, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, Q.vector_top(asked, vectors, 3).select("query_id", "id", "rank").collect())) == whole
    assert len(whole) == 21


def test_probed_recall(spark, sf_dir):
    from tessellum.plans import retrieval

    exact = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(spark, sf_dir).collect()}
    probed = {(r["query_id"], r["id"]) for r in retrieval.vector_topk_probed(spark, sf_dir).collect()}
    assert len(exact & probed) >= 0.9 * len(exact)


def test_graph(spark):
    nodes = spark.createDataFrame([(x, ["E"], x, i % 2) for i, x in enumerate("abcdefg")], "id string, labels array<string>, text string, document_id int")
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "S", "d"), ("d", "R", "e"), ("e", "R", "f"), ("f", "R", "g"), ("a", "R", "a")], "src string, rel_type string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "f"), ("a", "g"), ("a", "a"), ("b", "zz")], "start string, end string")
    assert {tuple(r) for r in G.shortest_paths(edges, pairs).collect()} == {("a", "d", 3), ("d", "a", 3), ("a", "f", 5)}
    assert {r["neighbour"] for r in G.neighbours(edges, nodes.filter("id = 'c'"), ["R"]).collect()} == {"b"}
    stay, left = G.delete_document(nodes, edges, 0)
    assert sorted(r["id"] for r in stay.collect()) == ["b", "d", "f"] and left.count() == 0
    up = G.upsert_nodes(spark.createDataFrame([("a", ["X"], 1, 1), ("a", ["Y"], None, 2)], "id string, labels array<string>, p int, version int")).first()
    assert up["labels"] == ["X", "Y"] and up["p"] == 1


def test_mutation(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert sorted(map(tuple, R.upserted(rows, spark.createDataFrame([(2, "z"), (3, "y")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "z"), (3, "y")]
    assert R.deleted(rows, F.col("v") == "a").collect()[0]["id"] == 2
    assert R.matches_schema(rows, rows.schema) and not R.matches_schema(rows.drop("v"), rows.schema)
    assert value(spark, R.progress(F.col("s"))["progress"], s="vectorizing") == 50
    assert value(spark, R.progress(F.col("s"))["stage"], s="?") == "unknown"


def test_link(spark):
    kb = spark.createDataFrame([("k1", "idea", ["ideas"], "T"), ("k2", "zebra", [], "T"), ("k3", "idea", [], "U")], "kb_id string, name string, aliases array<string>, type string").withColumn("kb_vector", Q.encoder()(F.col("name")))
    mentions = spark.createDataFrame([(1, 0, "Idea", "T"), (1, 1, "quark", "T"), (1, 2, "x", "none")], "doc_id long, pos int, text string, type string").withColumn("vector", Q.encoder()(F.col("text")))
    assert [(r["pos"], r["linked_id"], r["linking_status"]) for r in E.link(mentions, kb).orderBy("pos").collect()] == [(0, "k1", "linked"), (1, None, "nil"), (2, None, "nil")]


def test_stream_is_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    query = status.watch(status_events(status.event_source(spark, str(tmp_path / "in"), 2)), "states", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("states")) == rows(status.latest_status(status_events(events)))
    seen = []
    ingested = status.ingest(status.event_source(spark, str(tmp_path / "in"), 2), lambda df, n: seen.append(df.count()), str(tmp_path / "checkpoint2"))
    ingested.awaitTermination(120)
    assert sum(seen) == events.count()




def test_store(spark, tmp_path):
    from tessellum.operators import stores as T

    store = T.Store(spark, f"file://{tmp_path}/store")
    assert store.tables() == [] and not store.exists("a")
    one = spark.createDataFrame([(1, "x")], "id int, v string")
    store.commit({"a": one, "b": one.withColumn("v", F.lit("y"))})
    before = store.read("a")
    store.commit({"a": one.limit(0)}, drop=("b",))
    assert store.tables() == ["a"] and store.read("a").count() == 0 and before.count() == 1 and store.size() >= 0
    store.append("a", one)
    assert [tuple(r) for r in store.describe("a").collect()] == [("id", "int"), ("v", "string")] and store.read("a").count() == 1
    assert T.collection(store, "vectors") and not T.collection(store, "vectors")
    with pytest.raises(ValueError, match="strings"):
        T.insert_vectors(store, "vectors", one)
    rows = spark.createDataFrame([("1", [1.0], '{"content_type": "title"}'), ("2", [2.0], None)], "id string, vector array<float>, metadata string")
    T.insert_vectors(store, "vectors", rows)
    assert {(r["id"], r["content_type"]) for r in store.read("vectors").collect()} == {("1", "title"), ("2", "fragment")}
    with pytest.raises(Exception, match="too long"):
        T.insert_vectors(store, "vectors", rows.withColumn("element_id", F.repeat(F.lit("x"), 101)))
    store.commit({"vectors": one})
    assert T.collection(store, "vectors") and sorted(store.read("vectors").columns) == sorted(T.VECTOR_FIELDS.names)


def test_ingestion_by_stages(spark, tmp_path):
    from tessellum.operators.stores import Store

    docs = spark.createDataFrame([(1, "a b c", 5), (2, " ", 5), (3, "a", 900), (4, None, 1), (4, None, 1)], "doc_id long, text string, n long")
    docs.write.parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")
    checks = {"extract_failed": F.length(F.trim("text")) > 0, "vectorize_failed": F.col("n") < 100}
    batch = status.ingest_into(store, "states", checks)
    status.ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), batch, str(tmp_path / "checkpoint")).awaitTermination(120)
    want = [(1, "completed"), (2, "extract_failed"), (3, "vectorize_failed"), (4, "extract_failed")]
    assert sorted(map(tuple, store.read("states").collect())) == want
    batch(docs, 0)
    assert sorted(map(tuple, store.read("states").collect())) == want


def test_files_of_a_folder(spark, tmp_path):
    from tessellum.sources.files import partition_files, read_files

    (tmp_path / "a.html").write_text("<h1>One &amp; x</h1><p>two <b>three</b></p><p> </p>", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("测试 a line of a text that is longer than any title is\n\n| c |".encode("gbk"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.md").write_bytes(b"\n")
    files = read_files(spark, str(tmp_path))
    assert files.count() == 4
    got = sorted((r["path"][-6:], r["elem_index"], r["elem_type"], r["text"], r["page"]) for r in partition_files(files).collect())
    assert [g[:3] for g in got] == [("/b.txt", 0, "NarrativeText"), ("/b.txt", 2, "Table"), ("a.html", 0, "Title"), ("a.html", 1, "NarrativeText")]
    assert {g[3] for g in got} >= {"two three", "| c |"} and any(g[3].startswith("测试") for g in got)


def test_containing(spark):
    from tessellum.functions.text import containing

    names = ["abcabc", "xbc", "c", "", None, "a.b", "zzabc"]
    words = ["abc", "bc", "c", "", "a.b", "abcabcd", None, "zabc"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, text string")
    got = containing(rows, "text", spark.createDataFrame([(w,) for w in words], "word string"), "word").select("id", "word").collect()
    assert sorted(map(tuple, got)) == sorted((i, w) for i, n in enumerate(names) for w in words if n and w and w in n)


def test_recall_without_relations(spark):
    nodes = spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("c", "Cyd"), ("d", "Annabel")], "id string, text string")
    edges = spark.createDataFrame([("a", "KNOWS", "b"), ("a", "KNOWS", "gone")], "src string, rel_type string, dst string")
    queries = spark.createDataFrame([(1, "Ann"), (2, "Cyd"), (3, "none"), (4, "Bob"), (4, "Cyd")], "query_id int, name string")
    got = {(r["query_id"], r["kind"], r["name"], r["id"]) for r in G.recall(queries, nodes, edges).collect()}
    assert got == {(1, "graph", "Ann", "a|KNOWS|b"), (2, "graph_entity", "Cyd", "c"), (4, "graph", "Bob", "a|KNOWS|b")}


def test_plan_of_paths_is_linear(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c")], "src string, rel_type string, dst string")
    plan = G.distances(edges, spark.createDataFrame([("a",)], "start string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0  # each hop has been written


def test_distances_reach_all_nodes(spark):
    import random

    rng = random.Random(3)
    pairs = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(70)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, starts = set(), ["v0", "v7", "v33", "unknown"]
    for start in starts:
        seen, ring = {start}, {start}
        for hops in range(1, 6):
            ring = {y for x in ring for y in near.get(x, ())} - seen
            seen |= ring
            want |= {(start, x, hops) for x in ring}
    edges = spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, rel_type string, dst string")
    got = G.distances(edges, spark.createDataFrame([(x,) for x in starts], "start string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


def test_missing_ends_and_names(spark):
    nodes = spark.createDataFrame([("s1",), ("p1",), ("p2",)], "id string")
    rows = spark.createDataFrame([("s1", "sold", "p1", 1, 5), ("s1", "sold", "p1", 2, 7), ("s1", "sold", "p2", 1, None), ("s1", "sold", "p3", 1, 4), ("s2", "sold", "p1", 1, 4), (None, "sold", "p1", 1, 4)], "src string, rel_type string, dst string, version int, n int")
    assert sorted(map(tuple, G.upsert_edges(rows, nodes).collect())) == [("s1", "SOLD", "p1", 7), ("s1", "SOLD", "p2", None)]
    from tessellum.plans import relational

    ids = spark.createDataFrame([(1,), (1,), (2,), (3,)], "document_id long")
    files = spark.createDataFrame([(1, "a.b.pdf"), (2, "plain"), (4, "d.txt")], "id long, filename string")
    assert sorted(map(tuple, relational._names(ids, files).collect())) == [(1, "a.b", 2), (2, "plain", 1), (3, "文档3", 1)]


def test_odd_ids_are_not_left_out(spark, sf_dir):
    from tessellum.plans import graph, relational

    dst = {int(r["dst"][1:]) % 2 for r in graph.graph_upsert_edges(spark, sf_dir).select("dst").distinct().collect()}
    assert dst == {0, 1}
    names = relational.document_names(spark, sf_dir).collect()
    assert any(r["document_id"] % 2 for r in names) and all(r["name"].startswith("doc_") for r in names)
