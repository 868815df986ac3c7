"""Repair against a search over all edits, and against a plain dynamic programme."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessellum.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def harmed(rows):
    out = []
    for c, turn, role, text, _ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def flags(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Dijkstra-free: all states, least (cost, audit, repaired) after each row, insertions closed twice."""
    best = {"": (0, "", ())}

    def closed(best):
        for _ in range(3):
            for s, (cost, audit, done) in list(best.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    t = NEXT.get((s, letter))
                    new = (cost + 2, audit + "I", (*done, role + ":"))
                    if t and (t not in best or new < best[t]):
                        best[t] = new
        return best

    best = closed(best)
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, new):
            if state not in after or new < after[state]:
                after[state] = new

        for s, (cost, audit, done) in best.items():
            offer(s, (cost + 3, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            if t := NEXT.get((s, role[:1])):
                offer(t, (cost + cut, audit + "K", (*done, f"{role}:{text}")))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if t := NEXT.get((s, letter)):
                    offer(t, (cost + 2 + cut, audit + "R", (*done, f"{name}:{text}")))
        best = closed(after)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows, damage=True):
    ids, convs = {r[0] for r in rows}, defaultdict(list)
    for r in harmed(rows) if damage else [(c, t, " " if role is None else role, " " if x is None else x) for c, t, role, x, _ in rows]:
        convs[r[0]].append(r)
    out = []
    for c in ids:
        mine = sorted(convs[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, turns = flags(mine), [r[1] for r in mine if r[1] is not None]
        cost, audit, done = cheapest(mine, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA)
    out = repair.repair(df, repair.damaged(repair.spaced(df)) if damage else None)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def many(seed, n=60):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, ""]
    texts = ["Fine.", "Cut", "Yes!", "", " \n", None, "Q?", "é🙂.", "More, then", "x" * 3000 + "."]
    rows = [(c, t + rng.choice([0, 0, 0, 5]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}.", 1) for c in range(n) for t in range(rng.randrange(1, 9))]
    return rows + [(None, 0, "user", "Hello.", 1), (None, 1, "system", "no", 1), (900, None, "user", "Hi.", 1), (900, None, "assistant", "Ho.", 1)] + rows[:30]


def test_against_a_plain_programme(spark):
    for damage in (True, False):
        rows = many(4)
        assert got(spark, rows, damage) == plain(rows, damage)


def test_blocks_and_chains(spark, monkeypatch):
    """Small blocks: most conversations take several, chained on three levels."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 1)
    monkeypatch.setattr(repair, "CHAIN_BITS", 1)
    rows = many(8, 25) + [(77, t, random.Random(t).choice(["user", "assistant", "system"]), f"t{t % 90}.", 1) for t in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(3))
def test_audits_of_all_edits(seed):
    """The plain programme against every sequence of edits of a few rows."""
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(1, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["A.", "b", ""])) for t in range(rng.randrange(4))]
        faults = flags(rows)
        found = []

        def go(i, made, cost, audit, room):
            if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(m[:1] for m in made)):
                found.append((cost, audit))
            if room:
                for role in ("user", "assistant"):
                    go(i, [*made, role], cost + 2, audit + "I", room - 1)
            if i < len(rows):
                cut = faults[i] == "truncated"
                go(i + 1, made, cost + 3, audit + "D", room)
                if faults[i] not in ("blank", "duplicate"):
                    go(i + 1, [*made, rows[i][2]], cost + cut, audit + "K", room)
                    for role in ("user", "assistant"):
                        go(i + 1, [*made, role], cost + 2 + cut, audit + "R", room)

        go(0, [], 0, "", 4)
        assert min(found) == cheapest(rows, faults)[:2]


def test_small_tables(spark):
    assert got(spark, []) == []
    lone = [next((c, 0, "user", "x.", 1) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)]
    assert got(spark, lone) == [(lone[0][0], 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]
