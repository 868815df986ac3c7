"""The pipeline on a small fixture against a plain restatement, and queries with SQL against DuckDB."""

import hashlib
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessellum.llm import queries, toxicity
from tests.llm.test_decontam_quality import words
from tests.llm.test_dedup import brute_components, brute_repeats


def fixture_rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(5, 12))).capitalize() + ". "
    passage = "".join(sentence() for _ in range(8))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(5)]
    docs, labels = [], []
    for i in range(220):
        text = "".join(sentence() for _ in range(rng.randrange(3, 10)))
        if i % 9 == 0:
            text += passage
        if i % 13 == 0:
            text += items[i % 5][1]
        if i % 17 == 0 and docs:
            text = docs[rng.randrange(len(docs))][1].replace("a", "o", 1)
        toxic = i % 6 == 1
        if toxic:
            text += "you idiot. what a moron you are, idiot"
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    return [*docs, (900, None), (901, ""), (5, docs[5][1])], labels, items


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs, labels, items = fixture_rows()
    write = lambda name, rows, **types: pq.write_table(pa.table({k: pa.array([r[n] for r in rows], t) for n, (k, t) in enumerate(types.items())}), folder / f"{name}.parquet")
    write("documents", [(*d, "en", "s", None if d[1] is None else len(d[1])) for d in docs], doc_id=pa.int64(), text=pa.string(), lang=pa.string(), source=pa.string(), n_chars=pa.int64())
    write("labels", labels, doc_id=pa.int64(), quality=pa.int32(), toxic=pa.int32())
    write("benchmark", items, item_id=pa.int64(), text=pa.string())
    return str(folder)


def test_pipeline(spark, small):
    docs, _, items = fixture_rows()
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{small}/labels.parquet").filter(~toxicity.held_out()))
    rows = [(i, t) for i, t in docs if model.score(toxicity.Bag(pa.array([t], pa.large_string()), model.known))[0] < toxicity.THRESHOLD]
    assert 20 < len(docs) - len(rows) < 60
    kept = {i for i, _, _, k in brute_components(rows) if k}
    assert len(kept) < len({i for i, _ in rows})
    rows = [(i, t) for i, t in dict(rows).items() if i in kept]
    cut = [(i, t) for i, t, _, _ in brute_repeats(rows)]
    assert sum(n for _, _, _, n in brute_repeats(rows)) > 50
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(len(w) - 9)}
    clean = [(i, t) for i, t in cut if not any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))]
    assert len(clean) < len(cut)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).columns == docs.columns


def test_stages_decide_by_row(spark, small):
    """Rows of one id and different texts, repeated rows, null ids, and columns that operators use themselves."""
    rng = random.Random(3)
    words_ = lambda n: " ".join("".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    a, b, c = words_(60), words_(60), words_(60)
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    names = "doc_id long, text string, score string, predicted string, n_removed string, n_sentences string, node string, count string, kept string"
    extra = ("s", "p", "r", "n", "o", "c", "k")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (None, words_(30)), (None, None), (9, ""), (11, item), (11, words_(30))]
    docs = spark.createDataFrame([(*r, *extra) for r in rows] + [(7, c, "t", *extra[1:])], names)
    once = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert once(near) == sorted([(1, a), (5, b), (7, c), rows[5], (None, None), (9, ""), rows[8], rows[9]], key=repr)
    assert {r["score"] for r in near.filter("doc_id <> 7").collect()} == {"s"}
    clean = corpus_pipeline.drop_contaminated(spark, docs, small)
    assert once(clean) == sorted([(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] != item], key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns, name
        assert {tuple(r)[3:] for r in got.collect()} == {extra[1:]}, name
        assert stage(spark, docs.limit(0), small).collect() == []
    assert corpus_pipeline.encode(spark, docs, small).count() == len(rows) + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def test_contract_columns(spark, sf_dir):
    want = {
        "op1": "doc_id held_out score predicted", "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6": "doc_id n_shingles component_id kept",
        "op7": "page_id host path rule verdict", "op8": "doc_id start n_tokens ids_crc32", "op9": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, query in queries.QUERIES.items():
        if columns := want.get(name.split("_")[0]):
            assert set(columns.split()) <= set(query(spark, sf_dir).columns), name
