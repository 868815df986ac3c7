"""The stored index of names against plain substring search."""

import random

from tessellum.functions import text
from tessellum.operators.names import NameIndex, add_names, search_substring


def test_every_substring_is_found(spark, tmp_path):
    draw = random.Random(5)
    names = ["".join(draw.choice("ab细") for _ in range(draw.randrange(9))) for _ in range(80)] + [None, "", "a", "aaaaaa", "x.y%z", "😀ab😀"]
    rows = [(str(i), n) for i, n in enumerate(names)]
    patterns = sorted({"".join(draw.choice("ab细") for _ in range(draw.randrange(1, 7))) for _ in range(60)} | {"aaaa", "x.y%", "😀ab😀", "zzz", "zzzz", "y%z", "."})
    index = NameIndex(spark, f"{tmp_path}/names")
    add_names(index, spark.createDataFrame(rows[:50], "id string, text string"), "one")
    add_names(index, spark.createDataFrame(rows[50:], "id string, text string"), "two")
    add_names(index, spark.createDataFrame(rows[50:], "id string, text string"), "two")  # again under its name
    add_names(index, spark.createDataFrame([], "id string, text string"))
    asked = spark.createDataFrame([(p,) for p in [*patterns, None, "", patterns[0]]], "pattern string")
    got = sorted(map(tuple, search_substring(index, asked).collect()))
    assert got == sorted((p, i) for p in patterns for i, n in rows if n and p in n)


def test_few_patterns_go_to_the_texts(spark, monkeypatch):
    """the grams of the texts are not shuffled to a handful of patterns, and only those of asked lengths are made."""
    names = spark.createDataFrame([(str(i), f"Customer#{i:05d}") for i in range(40)] + [("x", None), ("y", "")], "id string, text string")
    asked = spark.createDataFrame([("1",), ("r#0",), ("mer#0002",), ("zzz",), ("",), (None,)], "word string")
    want = sorted((w, str(i)) for w in ("1", "r#0", "mer#0002") for i in range(40) if w in f"Customer#{i:05d}")
    few = text.containing(names, "text", asked, "word")
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["word"], r["id"]) for r in few.collect()) == want
    monkeypatch.setattr(text, "FEW", 0)
    assert sorted((r["word"], r["id"]) for r in text.containing(names, "text", asked, "word").collect()) == want
    assert text.containing(names, "text", asked.limit(0), "word").count() == 0


def test_patterns_of_one_gram_share_its_postings(spark, tmp_path):
    """rows of the search grow with the places of grams, not with the patterns that have them too."""
    index = NameIndex(spark, f"{tmp_path}/shared")
    names_ = [(str(i), f"n{i % 10}abc{i % 7}abcx") for i in range(30)]
    add_names(index, spark.createDataFrame(names_, "id string, text string"))
    stored = index.read("postings", "gram string, id string, places array<int>")
    assert stored.filter("size(places) <> 1").count() == 0 and stored.filter("gram = 'abc' and id = '3'").count() == 2
    patterns = [f"abc{k}" for k in range(10)] + [f"{k}abc" for k in range(10)] + ["abcx", "3abcx", "cxx1"]
    found = search_substring(index, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted((p, i) for p in patterns for i, n in names_ if p in n)
