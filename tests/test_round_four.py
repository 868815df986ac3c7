"""What findings of the fourth round were about: linking without rows of candidates, evidences that are sent once."""

import hashlib
import random
from collections import Counter

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import extraction as E
from tessellum.operators import graph as G
from tessellum.operators import retrieval as Q
from tessellum.plans import extraction as X
from tests.test_growth import hops


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ")


def test_mentions_are_linked_where_they_are_found(spark, sf_dir):
    """the same links as of the join with the knowledge base, without a row for a candidate or a shuffle of mentions."""
    entries = [*X.KB, ("kb6", "The", None, "Protein", None), ("kb7", "and", ["x"], "CellLine", ""), ("kb8", "x of", [], "Metric", ""), *[(f"kc{i}", "and" + "x" * i, ["an", "the and"], "CellLine", "") for i in range(14)]]
    kb = spark.createDataFrame(entries, "kb_id string, name string, aliases array<string>, type string, description string")
    kb = kb.withColumn("kb_vector", Q.encoder()(E.entry_input(F.col("name"), F.col("description"))))
    rng = random.Random(2)
    texts = [(i, rng.choice(["the", "The an", "and", "AND this", "x of", "", "thing than"]) + " " * (i % 3), rng.choice(["Protein", "CellLine", "Metric", "None", None]), rng.choice(["", "the end", "und an é\U0001f600", "and" * 9])) for i in range(200)]
    mentions = spark.createDataFrame([(1, *t) for t in texts], "doc_id long, pos int, text string, type string, context string")
    vectors = mentions.withColumn("vector", Q.encoder()(E.mention_input(F.col("text"), F.col("context")))).drop("context")
    rows = lambda df: {r["pos"]: (r["linked_id"], r["linking_status"], r["link_score"] and round(r["link_score"], 9)) for r in df.collect()}
    got = rows(E.link_entries(mentions, entries))
    assert got == rows(E.link(vectors, kb)) and len(got) == 200
    assert len({x[0] for x in got.values()}) > 2
    assert exchanges(X.linked_mentions(spark, sf_dir)) == 1


def test_texts_are_hashed_in_blocks(monkeypatch):
    """an encoder of many texts at once gives what it gives for each."""
    texts = ["", "a", "ab", "Abc", "é\U0001f600 of", "İ ΟΔΟΣ", "x" * 90, "the end"] * 5
    monkeypatch.setattr(Q, "CODES", 64)
    both = Q.HashedEncoder().encode(texts)
    assert (both == [Q.HashedEncoder().encode([t])[0] for t in texts]).all() and both[3, (97 * 961 + 98 * 31 + 99) % 64] == 1


def test_sentences_of_evidences_are_sent_once(spark, sf_dir, monkeypatch):
    """counts and digests of window relations, with a sentence shuffled once and a relation of a large document in a task of its own."""
    rng = random.Random(5)
    terms = [("the", "the", "Protein", 2), ("and", "and", "CellLine", 1), ("of", "of", "Metric", 5), ("than", "than", "Reagent", 3), ("an", "an", "Protein", 1)]
    pairs = [*E.TYPE_PAIRS, ("Protein", "Protein", "produces")]
    words = ["the", "and", "The", "of", "than", "x", "é\U0001f600", ". ", "! ", ";;", " ", "　 ", "\n"]
    rows = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for d in range(25)] + [(90, ""), (91, None), (92, "the and"), (None, "and the. of the.")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = E.scan(texts, terms)
    mentions = found.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end")) - 1)
    columns = ["doc_id", "head", "head_type", "relation", "tail", "tail_type", "confidence", "evidence_count", "evidence_md5"]
    listed = lambda df: sorted(map(tuple, df.select(columns).collect()))
    want = listed(E.evidence_digests(E.window_relations(mentions, E.sentences(texts), pairs)).filter("doc_id is not null"))
    monkeypatch.setattr(E, "HASHED", 2000)
    sentences = E.scan_sentences(texts, terms)
    assert sentences.agg(F.max("shares")).first()[0] > 1
    plain = lambda df: sorted((r["doc_id"], r["sent_no"], r["sentence"]) for r in df.filter("doc_id is not null").collect())
    assert plain(sentences) == plain(E.sentences(texts))
    assert listed(E.scanned_digests(sentences, pairs)) == want and len(want) > 100
    counted = E.scan_relation_counts(texts, terms, pairs).select("doc_id", "head", "relation", "tail", "evidence_count").collect()
    assert sorted(map(tuple, counted)) == sorted((w[0], w[1], w[3], w[4], w[7]) for w in want)
    assert exchanges(X.relation_evidence(spark, sf_dir)) == 1


def test_a_long_text_is_hashed_as_often_as_it_counts():
    digest, text = E._Digest("a", "b"), b" | some text"
    for times, block in ((7, 3), (1, 5), (12, 4)):
        digest.take(times, memoryview(text * block), len(text))
    assert digest.count == 20 and digest.md5.hexdigest() == hashlib.md5((text * 20)[3:]).hexdigest()


def test_relations_are_counted_without_texts(spark, sf_dir):
    """the summary shuffles neither sentences nor mentions with vectors."""
    plan = X.extraction_summary(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert exchanges(X.extraction_summary(spark, sf_dir)) <= 4
    assert not [line for line in plan.split("\n") if "Project" in line and "sentence#" in line]


def test_starts_and_ends_meet_by_lists(spark, monkeypatch):
    """what is written of starts and ends are lists, the rows are made of one of each, and no join stands after the walk."""
    sizes, write = {}, G.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(G, "written", counted)
    monkeypatch.setattr(G, "PACKED", 7)
    monkeypatch.setattr(G, "SALTS", 2)
    edges = [(f"l{i}", "E", f"h{i % 2}") for i in range(60)] + [("h0", "E", "h1"), ("x", "E", "y")]
    starts = [f"l{i}" for i in range(0, 60, 2)] + ["h0", "x"]
    found = G.distances(spark.createDataFrame(edges, "src string, rel_type string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), 3)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(x for s in starts for x in hops(edges, s, 3)) and len(rows) > 1800 and sizes["packs"] < 150
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_tokens_as_by_the_pattern(spark, monkeypatch):
    """tokens of an index by a table of characters, in pieces, are those of the pattern, which queries go by; and white space falls off without a pattern."""
    every = spark.range(1, 0x110000, 1, 4).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.filter(F.regexp_replace("c", r"(?U)^\s+|\s+$", "") != T.strip(F.col("c"))).count() == 0
    rows = every.groupBy(F.floor(F.col("id") / 500).alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda x: x["c"]), "").alias("text"))
    odd = ["", None, "the", "Of THE end", "中文 and 中x文1", "é\U0001f600É\U00020000b", " a-b_c.d  ", "x" * 50, "İI ΟΔΟΣ", "The", ""]
    rows = rows.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "seq long, text string"))
    monkeypatch.setattr(Q, "CUT", 600)
    monkeypatch.setattr(Q, "LISTED", 5000)
    lists = Q._lists(rows.coalesce(3), ["text"]).select("term", "n", "firsts", "total", "body").collect()
    got = Counter()
    for r in lists:
        _, tf, _ = Q._unpacked(r["body"]).reshape(3, -1)
        got[r["term"]] += int(tf.sum())
    tokens = rows.select("seq", F.explode(T.tokens(F.col("text"))).alias("term")).localCheckpoint()
    assert got == {r["term"]: r["count"] for r in tokens.groupBy("term").count().collect()} and len(got) > 90_000
    assert sum(r["total"] for r in lists) == tokens.count() and sum(r["firsts"] for r in lists) == tokens.select("seq").distinct().count()
