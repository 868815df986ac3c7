"""A dictionary in a table against the automaton and against every window of the texts."""

import random

from pyspark.sql import functions as F

from tessellum.operators import extraction as E

TERM = "term string, canonical string, type string, priority int"
TEXT = "doc_id long, text string"


def rows(df):
    return sorted(map(repr, df.select("doc_id", "start", "end", "text", "canonical", "type", "priority").collect()))


def test_same_rows_as_the_automaton(spark, monkeypatch):
    monkeypatch.setattr(E, "PIECE", 16)
    draw = random.Random(2)
    letters = "abAB细é"
    texts = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(90)))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "ΑΣ ab İstanbul ΣΑΣ"), (53, "ab" * 40), (53, "ab" * 40), (53, "other ab"), (None, "abab")]
    names = sorted({"".join(draw.choice("ab细é") for _ in range(draw.randrange(1, 9))) for _ in range(80)} | {"ab" * 10, "ασ", "zzzzz"})
    terms = [(t, t.upper(), "T", i) for i, t in enumerate(names)]
    found = E.scan_table(spark.createDataFrame(texts, TEXT), spark.createDataFrame(terms, TERM))
    known = [t for t in texts if t[0] is not None]
    assert rows(found.filter("doc_id is not null")) == rows(E.scan(spark.createDataFrame(known, TEXT), terms))
    assert found.filter("doc_id is null").count() == sum("abab".startswith(t, i) for t in names for i in range(4))
    dotted = E.scan_table(spark.createDataFrame(texts, TEXT), spark.createDataFrame([("İS", "x", "T", 1)], TERM))  # the automaton's terms get longer in lower case
    assert [(r["start"], r["text"]) for r in dotted.collect()] == [(6, "İs")]
    assert E.scan_table(spark.createDataFrame(texts, TEXT), spark.createDataFrame([], TERM)).count() == 0
    assert E.scan_table(spark.createDataFrame([], TEXT), spark.createDataFrame(terms, TERM)).count() == 0


def test_a_million_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(20)
    made = spark.range(1_000_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("term"))
    words = docs.select(F.explode(F.split(F.lower("text"), r"\W+")).alias("term")).filter("length(term) > 0").distinct()
    terms = made.union(words).distinct().select("term", F.col("term").alias("canonical"), F.lit("T").alias("type"), F.lit(1).alias("priority"))
    got = E.scan_table(docs, terms).select("doc_id", "start", "end").collect()
    own = {r[0] for r in words.collect()}
    most = max(map(len, own))
    want = [(r["doc_id"], i, i + n) for r in docs.collect() for i in range(len(r["text"])) for n in range(1, most + 1) if i + n <= len(r["text"]) and r["text"][i : i + n].lower() in own]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_parts_of_the_dictionary_meet_shares_of_the_texts(spark, monkeypatch):
    """no gram of a text is a row; each part of the dictionary goes over each share of the texts."""
    monkeypatch.setattr(E, "PIECE", 16)
    monkeypatch.setattr(E, "PART", 7)
    monkeypatch.setattr(E, "SHARE", 3)
    draw = random.Random(3)
    texts = [(2**60 + i, "".join(draw.choice("abAB细") for _ in range(draw.randrange(60)))) for i in range(20)]
    terms = [(t, t, "T", 1) for t in sorted({"".join(draw.choice("ab细") for _ in range(draw.randrange(1, 6))) for _ in range(40)})]
    terms += [("ab", "other", None, None), terms[0], terms[0]]
    found = E.scan_table(spark.createDataFrame(texts, TEXT), spark.createDataFrame(terms, TERM))
    want = sorted(repr((d, i, i + len(t), x[i : i + len(t)], c, k, p)) for d, x in texts for t, c, k, p in terms for i in range(len(x)) if x[i : i + len(t)].lower() == t)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() > 20
