"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellum.llm import bpe, tokenbin
from tessellum.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "  two  blanks ", "a\tb\r\nc", "it's we'll 'd x's", "naïve café über", "数据 分析", "x<|endoftext|>y", "foo  <|endoftext|>  bar<|endoftext|>", "\x1f \x1c\x85\xa0 \u2003z",
    "🙂🙂 👩‍👩‍👧", "1234567 12.5%", "\n\nA\n B \n", "e\u0301\u200d", "word.\nNext, line\n", "a" * 5000, "x\x00y", "-- __ ##", "\u180e a", "don't'", "Ａ１",
]


def text_hash(t):
    h = xxhash.xxh64(t.encode(), seed=42).intdigest() if t is not None else 42
    return h - (1 << 64 if h >= 1 << 63 else 0)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    alphabet = list("abcdeé ßñ  \n\n.,'%1 9\t\u3000\u0301数🙂\x1f\x85") + ["'s", " the", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_codec_is_the_library(library):
    c = bpe.codec(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == want, t
        assert c.decode(np.array(want)) == library.decode(want, skip_special_tokens=False), t
    assert c.encode(None).tolist() == []
    some = [5000, 12, 200, 222, 50256, 187]
    assert c.decode(np.array(some)) == library.decode(some, skip_special_tokens=False)


def test_cached_encoder_is_the_library(library):
    enc = tokenbin.Encoder(PATH)
    for _ in range(2):
        for t, packed in zip(texts(), enc.encode_batch(texts()), strict=True):
            assert np.frombuffer(packed, enc.width).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_encode_decode_frames(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(999, None), (0, ODD[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = bpe.bpe_encode(df, PATH)
    back = bpe.bpe_decode(encoded, PATH).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t in rows)
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(df, PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_files(spark, library):
    rows = [(3, "c c"), (None, "none"), (1, None), (2, ""), (3, "b"), (-7, "x " * 3000)] + [(100 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    out = fresh_path(spark, "test")
    tokenbin.write_tokens(df, out, PATH, parts=4)
    got = sorted(tokenbin.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    digests = sorted(tokenbin.read_tokens(spark, out, digests=True).collect(), key=lambda r: r["start"])
    at = 0
    for (i, t), r, d in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), r[1] is not None, r[1] or "")), got, digests, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        assert d["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = fresh_path(spark, "test")
    assert tokenbin.write_tokens(df, out, PATH)["n_ids"] == 0
    assert tokenbin.read_tokens(spark, out).collect() == []
    assert bpe.bpe_encode(df, PATH).collect() == []


def test_rows_of_one_id_are_dealt_among_parts(spark):
    rows = [(i, f"t{i}") for i in range(60)] + [(7, f"many {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenbin.ranged(df, "doc_id", "text", 16).select("doc_id", "text", F.spark_partition_id().alias("part")).collect()
    sizes = Counter(r["part"] for r in got)
    assert max(sizes.values()) < 120 and len(sizes) > 8
    order = [(r["part"], r["doc_id"] is not None, r["doc_id"] or 0, text_hash(r["text"])) for r in got]
    assert sorted(order) == sorted(order, key=lambda x: (x[1:], x[0])) and len(got) == len(rows)
