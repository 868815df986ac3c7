"""Near duplicates and repeated spans against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from tessellum.llm import near_dedup, span_dedup
from tessellum.llm.common import Scratch
from tessellum.llm.components import connected


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [(i, sets(t)) for i, t in rows]
    for k, (i, x) in enumerate(s):
        for j, y in s[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(x), find(i) if x else i, (find(i) if x else i) == i) for i, x in s)


def near_rows(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(30))
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for _ in range(25):  # families of copies with a few words changed, and chains of ever more changes
        base = [word() for _ in range(rng.randrange(30, 150))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                base = copy
            rows.append(" ".join(copy))
    for _ in range(60):  # many share one passage and are no copies
        rows.append(" ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)]))
    rows += ["", None, "  \n", "One two", "one TWO", "one two three", "É à", "é à", "x " * 3000, "x " * 3001, rows[3], rows[3], rows[40]]
    rng.shuffle(rows)
    return [(7 * k % 1009, t) for k, t in enumerate(rows)]


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_shingles int")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute_components(rows)
    assert sum(not r["kept"] for r in got) > 50
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_unlike_documents_of_one_bucket(spark):
    """Many documents that share most of their words and few that are similar enough: the prefix filter loses none of these."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(300))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join([*[word() for _ in range(rng.randrange(4, 24))], *common, *[word() for _ in range(rng.randrange(0, 6))]])) for i in range(120)]
    want = brute_components(rows)
    assert 2 < len({c for _, _, c, _ in want}) < 110
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == want


def test_scratch_goes(spark):
    rows = near_rows(5)[:80]
    with Scratch(spark) as scratch:
        out = scratch.keep(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch=scratch), "out")
        assert set(scratch.paths) == {"signatures", "classes", "out"}
    assert out.count() == 80 and set(scratch.paths) == {"out"}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (5, "other " + text), (6, None), (None, "alone here"), (6, "z")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in got) == sorted([("None", 26, "5", False), ("5", 26, "5", True), ("5", 26, "5", True), ("5", 27, "5", True), ("6", 0, "6", True), ("None", 1, "None", True), ("6", 1, "6", True)])


def test_superminhash():
    rng = np.random.default_rng(1)
    for n, common in ((4, 3), (60, 45), (900, 700)):
        errors = []
        for _ in range(30):
            u = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            x, y = u[:n], u[n - common :]
            keys, of = np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)])
            s = near_dedup.superminhash(keys, of, 2)
            assert (s < np.iinfo(np.uint64).max).all()
            errors.append((s[0] == s[1]).mean() - len(set(x) & set(y)) / len(set(x) | set(y)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    one = pa.array(["a b c d e f g", "G f e d c b a", "A b C d e f g"])
    keys, of, n = near_dedup.shingles(one)
    s = near_dedup.signatures(keys, of, n)
    assert (s[0] == s[2]).all() and not (s[0] == s[1]).any()


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, i) for i in range(900, 990)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5), (None, 3), (77777, 77777)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, find(x)) for x in root)
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def brute_sentences(text):
    """[(start, words)] by a plain scan."""
    found, begin = [], True
    for m in re.finditer(r"[^\x20\x09-\x0D]+?[。！？]|[^\x20\x09-\x0D]+", text or ""):
        w = m[0]
        gap = text[found[-1][2] : m.start()] if found else ""
        if not found or begin or "\n" in gap:
            found.append([m.start(), [], m.end()])
        found[-1][1].append(w)
        found[-1][2] = m.end()
        begin = bool(re.search(r"[.!?。！？]$|[.!?][\"')\]]$", w))
    return [(a, w) for a, w, _ in found]


def brute_repeats(rows):
    places = {}
    for i, t in rows:
        s = brute_sentences(t)
        runs = set()
        for k in range(len(s)):
            for forward in (True, False):
                a = b = k
                while 0 <= a and b < len(s) and (b - a + 1 < 2 or sum(len(w) for _, w in s[a : b + 1]) < 20):
                    a, b = (a, b + 1) if forward else (a - 1, b)
                if 0 <= a and b < len(s):
                    runs.add((a, b))
        for a, b in runs:
            places.setdefault(tuple(w for _, v in s[a : b + 1] for w in v), []).append((i, a, b))
    gone = {i: set() for i, _ in rows}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b + 1))
    out = []
    for i, t in rows:
        s = brute_sentences(t)
        if gone[i]:
            stops = [a for a, _ in s[1:]] + [len(t)]
            kept = t[: s[0][0]] + "".join(t[a:b] for k, ((a, _), b) in enumerate(zip(s, stops)) if k not in gone[i])
            t = kept.rstrip(" \t\n\r\v\f") if len(s) - 1 in gone[i] else kept
        out.append((i, t, len(s), len(gone[i])))
    return sorted(out)


def span_rows():
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice(["an", "Be", "ço", "dé", "x", "É"]).lower() + rng.choice("aeiou") * rng.randrange(3) for _ in range(rng.randrange(1, 14))).capitalize() + rng.choice([". ", "! ", '." ', "\n", ".\n", "。"])
    passages = ["".join(sentence() for _ in range(7)) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [sentence() for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["", "and so "]) + rng.choice(passages) + rng.choice(["", "then "]))
        rows.append((i, "".join(parts)))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, rows[5][1]), (204, "One. two. " * 800), (205, "no end at all " * 30), (206, "no end at all " * 30)]


def test_span_dedup(spark):
    rows = span_rows()
    df = spark.createDataFrame([(i, t, "z", 4) for i, t in rows], "doc_id long, text string, span string, n_removed int")
    got = span_dedup.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "span", "n_sentences", "n_removed"]
    got = sorted((r["doc_id"], r["text"] if r["text"] is not None else None, r["n_sentences"], r["n_removed"]) for r in got.collect())
    want = brute_repeats(rows)
    assert got == want
    assert sum(r[3] > 0 for r in want) > 30
    assert span_dedup.remove_repeats(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, rows[204 - 204 + 5][1] * 3), (1, rows[5][1] * 3), (None, rows[5][1] * 3)], "doc_id long, text string")
    out = span_dedup.remove_repeats(same).collect()
    assert len(out) == 3 and [r["n_removed"] for r in out if r["doc_id"] is None][0] == max(r["n_sentences"] for r in out)


def test_passages_in_mid_sentence(spark):
    """Passages of 51 words and more go from their second place, wherever sentences begin and end."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3))
    words = lambda n: [word() for _ in range(n)]
    shapes = [[51], [60], [84], [26, 26], [16, 36], [36, 16], [17, 17, 17], [16, 19, 16], [25, 5, 25], [16, 9, 10, 16], [20, 3, 12, 17]]
    rows, long = [], []
    for k, shape in enumerate(shapes * 3):
        passage = ". ".join(" ".join(words(n)) for n in shape)
        for i in (2 * k, 2 * k + 1):
            before, after = words(rng.randrange(3, 40)), words(rng.randrange(3, 40))
            rows.append((i, " ".join([*before, passage, *after])))
            long.append((before, passage.split(" "), after))
    rows += [(900, " ".join(words(51)) + "."), (902, " ".join(words(300)))]
    rows += [(901, rows[-2][1]), (903, "once " + rows[-1][1] + " more")]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:-4] + rows[-4:-2]:
        if i % 2 == 0:
            assert (got[i]["text"], got[i]["n_removed"]) == (text, 0)
    for i, (before, passage, after) in enumerate(long):
        if i % 2:
            left = got[i]["text"].split(" ")
            assert left[: len(before)] == before and left[-len(after) :] == after and got[i]["n_removed"] > 0
            stayed = left[len(before) : -len(after)]
            assert len(stayed) <= 2 * (span_dedup.REACH - 1) < len(passage) / 2
            head = next((k for k, (x, y) in enumerate(zip(stayed, passage)) if x != y), len(stayed))
            assert stayed[head:] == passage[len(passage) - len(stayed) + head :]
    assert len(got[901]["text"].split()) <= 24 and 2 <= len(got[903]["text"].split()) <= 26


def test_capitals_start_no_sentence(spark):
    text = "Der Mann geht mit dem Hund durch den Wald und die Frau liest das Buch im Garten. Anna und Émile sehen New York!"
    got = span_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts=("n", "m")).first()
    assert (got["n"], got["m"], got["text"]) == (2, 0, text)


def test_cuts_stay_with_their_text(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3))
    sentences = lambda n: " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    passage, clean, own = sentences(4), sentences(6), [sentences(3) for _ in range(5)]
    rows = [(1, passage), (2, passage + " " + own[0]), (2, clean), (None, passage + " " + own[1]), (None, clean + " " + own[2]), (3, own[3])]
    copies = sentences(5)
    rows += [(None, copies + " " + own[4]), (None, copies + " " + own[3])]
    got = sorted((repr(r["doc_id"]), r["text"], r["n_removed"]) for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] != "None"] == sorted([("1", passage, 0), ("2", own[0], 4), ("2", clean, 0), ("3", own[3], 0)])
    nulls = [r[1:] for r in got if r[0] == "None"]
    assert (own[1], 4) in nulls and (own[2], 6) in nulls
    assert sum(copies in t for t, _ in nulls) == 1 and sum(n for _, n in nulls) == 4 + 6 + 5 + 3
