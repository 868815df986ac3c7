"""Positional index and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import decontam, quality, tokenbin

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "of", "É", "zoë", "x1", "数", "q", "r", "ÀB"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ".\n", "-"]) for _ in range(k))
    items = [(i, text(rng.randrange(1, 14))) for i in range(30)] + [(30, None), (31, ""), (32, "..."), (33, "a b"), (33, "b q")]
    docs = [(i, text(rng.randrange(0, 60)) + (rng.choice(items)[1] or "") + text(5)) for i in range(n)] + [(7, None), (8, ""), (9, "--"), (10, text(4000)), (11, None)]
    return docs, items


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(len(v) - window + 1) if len(v) >= window else [0] * bool(v):
                want = v[k : k + window]
                for j in range(len(w) - len(want) + 1):
                    if w[j : j + len(want)] == want:
                        hit |= set(range(j, j + len(want)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 40, "held_bytes": 0}])
def test_contamination(spark, limits):
    docs, items = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = decontam.contamination(df, bench, **limits).select(*columns).collect()
    assert sorted(map(tuple, got)) == brute(docs, items)
    assert sum(r["contaminated"] for r in got) > 20
    assert decontam.contamination(df.limit(0), bench).collect() == []
    assert not any(r["n_hit"] for r in decontam.contamination(df, bench.limit(0)).collect())


def test_ids_of_other_types(spark):
    docs, items = corpus(30)
    df = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in items] + [(None, "zz zz")], "item_id string, text string")
    got = decontam.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items").collect()
    assert sorted(map(tuple, got)) == sorted((f"d{i}", *rest[:3]) for i, *rest in brute(docs, items))
    with pytest.raises(ValueError, match="string"):
        tokenbin.write_tokens(df, "unused", "unused")


def test_proximity(spark):
    docs = [(1, "red x green y blue"), (2, "blue green red"), (3, "red a b c d e f g h i j green blue"), (4, "red red green"), (5, "red blue"), (6, None)]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(1, "red green blue"), (2, "red red green")], "item_id long, text string")
    got = {r["doc_id"]: sorted((m["item_id"], m["start"], m["end"]) for m in r["matches"]) for r in decontam.search(index, items, span=5).collect()}
    assert got == {1: [(1, 0, 5)], 2: [(1, 0, 3)], 3: [], 4: [(2, 0, 3)], 5: [], 6: []}


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(4)
    vocabulary = ["good", "Tree", "é", "ñu", "##", "a%", "　x", "数"]
    texts = ["".join(rng.choice(vocabulary[: rng.randrange(1, 9)]) + rng.choice([" ", "  ", "\n", "\t", "\n\n", "\x0b"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    return [(i, t) for i, t in enumerate([*texts, None, "", "\n", " a", "x " * 50_000])] + [(3, texts[3])]


def plain_score(grams, raw, target, own):
    """The mean log ratio by plain counts, without the text's own n-grams."""
    mine = Counter(grams)
    n_raw, n_target, total = sum(raw.values()) - len(grams), sum(target.values()) - own * len(grams), 0.0
    for x, k in mine.items():
        share = (raw[x] - k + 1) / (n_raw + quality.BUCKETS)
        total += k * np.log(((target[x] - own * k) / share + quality.PRIOR) / (n_target + quality.PRIOR))
    return total / max(len(grams), 1)


def bucket_grams(text):
    """n-grams as the buckets that the hash gives them."""
    bucket, _ = quality.Counted(pa.array([text], pa.large_string())).ngrams()
    return bucket.tolist()


def test_quality(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, own string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60)] + [(3,), (None,)], "doc_id long")
    got = quality.judge(df, trusted).collect()
    assert len(got) == len(rows)
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = bucket_grams(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(g) == len(w) + max(len(w) - 1, 0)
        raw.update(g)
        target.update(g if i < 60 else [])
    of = dict(rows)
    scores = sorted(r["score"] for r in got if r["doc_id"] < 60 and not r["base_failed"])
    limit = max(x for x in scores if sum(y < x for y in scores) <= quality.TAIL * len(scores))
    for r in got:
        t = of[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert abs(plain_score(bucket_grams(t), raw, target, r["doc_id"] < 60) - r["score"]) <= 0.51 / quality.STEPS
        assert r["kept"] == (not r["base_failed"] and r["score"] >= limit)
    assert len(scores) > 3 and any(r["kept"] for r in got)
    middle = scores[len(scores) // 2]
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= middle) for r in quality.judge(df, trusted, threshold=middle).collect())
    assert quality.judge(df.limit(0), trusted).collect() == []
    none = quality.judge(df, trusted.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and all(r["kept"] != r["base_failed"] for r in none)
    assert {r["kept"] for r in quality.judge(df, trusted, threshold=99.0).collect()} == {False}


def test_bitmap(spark):
    ids = [-5, 0, 7, 10**12, None]
    bits = quality.bitmap(spark.createDataFrame([(i,) for i in ids if i is not None], "doc_id long"))
    assert 1 <= sum(int(x).bit_count() for x in bits[bits > 0]) <= 4
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*ids, 8, 9]], "doc_id long, text string")
    known = spark.createDataFrame([(i,) for i in ids if i is not None], "__id long")
    assert sorted(r[0] for r in quality.trusted_texts(docs, known, "doc_id", "text").collect()) == ["t-5", "t0", "t1000000000000", "t7"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_unlabelled_are_kept_like_labelled(spark, sf):
    """At a small size too, documents without a label are kept about as often as labels are good, in each language."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"]: r for r in quality.judge(docs, labels.filter("quality = 1")).collect()}
    good = dict(labels.groupBy("doc_id").agg({"quality": "min"}).collect())
    passed = [r for r in docs.select("doc_id", "lang").collect() if not kept[r["doc_id"]]["base_failed"]]
    share = np.mean([good[r["doc_id"]] for r in passed if r["doc_id"] in good])
    for lang in ("en", "fr", "de", "es"):
        assert abs(np.mean([kept[r["doc_id"]]["kept"] for r in passed if r["lang"] == lang and r["doc_id"] not in good]) - share) < 0.1
    bad = [kept[r["doc_id"]]["kept"] for r in passed if good.get(r["doc_id"]) == 0]
    assert np.mean(bad) < 0.2 and np.mean([kept[r["doc_id"]]["kept"] for r in passed if good.get(r["doc_id"]) == 1]) > 0.95
