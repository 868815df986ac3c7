"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessellum.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def plain(rows):
    """Node -> its row, by walking every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - int(np.fmod(c, 5))
        made[c] = tuple(turns.get(leader, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        ends = sorted(c for c in members[p] if len(made[c]) == len(p))
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [out[k] for k in children[p]]
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def got(spark, rows, shard):
    df = trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), shard=shard)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def many(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "é🙂", "long " * 300, "b"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), 1) for c in range(-7, 60) if c % 7 for t in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(c, None, "user", "x", 1) for c in (3, 61)] + [(None, 1, "user", "lost", 1)] + rows[:20]  # repeated rows
    return rows + [(70, 0, "system", "S", 1), (71, 0, "system", "S", 1), (70, 1, "a", "q", 1)]


@pytest.mark.parametrize("shard", [4, 40, 1 << 16])
def test_against_prefixes(spark, shard):
    rows = many(3)
    assert got(spark, rows, shard) == plain(rows)


def test_long_and_copied_conversations(spark, monkeypatch):
    """One conversation with most of the turns, over several parts and stretches, and one copied many times."""
    monkeypatch.setattr(trie, "STRETCH_BITS", 4)
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(0, t, "user", f"t{t % 11}", 0) for t in range(300)] + [(5 * c, t, "user", f"s{t}", 0) for c in range(1, 40) for t in range(3)]
    assert got(spark, rows, 32) == plain(rows)
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows, 1000) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_small_tables(spark):
    assert got(spark, [], 8) == []
    assert got(spark, [(None, 0, "user", "x", 0)], 8) == []
    only = [(8, 0, "user", "x", 0)]
    assert got(spark, only, 8) == plain(only)


def test_bits_give_the_tree_back():
    rng = np.random.default_rng(5)
    parent = np.sort(np.r_[[-1, -1], [rng.integers(-1, i) for i in range(2, 200)]])
    bits = trie.louds(parent)
    assert bits.sum() == 200 and len(bits) == 401
    assert (trie.parents(bits) == parent).all()
    assert (trie.degrees(bits) == np.r_[np.bincount(parent[parent >= 0], minlength=200)]).all() or (trie.degrees(bits)[1:] == np.bincount(parent + 1, minlength=201)[1:200]).all()
