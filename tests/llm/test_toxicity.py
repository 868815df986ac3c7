"""The kernel machine against plain kernels, and its accuracy on rows held out."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessellum.llm import toxicity as T


def plain_kernel(x, y):
    def vector(w):
        symbols = [T.START, *(int(T.TABLE[ord(c)]) for c in w), T.END]
        v, square = {}, 0.0
        for i in range(len(symbols)):
            for j in range(i + 1, len(symbols)):
                for k in range(j + 1, min(len(symbols), i + T.SPAN)):
                    if symbols[i] and symbols[j] and symbols[k]:
                        w_ = T.DECAY ** (k - i - 2)
                        v[symbols[i] << 12 | symbols[j] << 6 | symbols[k]] = v.get(symbols[i] << 12 | symbols[j] << 6 | symbols[k], 0) + w_
                        square += w_**2
        return v, max(square, 1.0) ** 0.5

    (a, n), (b, m) = vector(x), vector(y)
    return sum(w * b.get(t, 0) for t, w in a.items()) / n / m


def test_kernel():
    words = ["idiot", "idi.ot", "Élan", "ab", "x", "thorough", "i d i o t"]
    for y in ("idiot", "lanthanum"):
        p = T.Segments.parse([y.encode()])
        table = np.zeros(T.SYMBOLS**3)
        for triple, _, w in p.triples():
            np.add.at(table, triple, w)
        table /= p.norms()[0]
        got = T.weigh([w.encode() for w in words], table)
        assert np.allclose(got, [plain_kernel(w, y) for w in words])
    assert T.weigh([b"--idiot", b"...", b""], table)[1:].tolist() == [0, 0]


def plain_score(model, text):
    """A text's score by plain loops: its segments, their margins and evidence, the second look, the logistic function."""
    marks = T.MARKS.decode()
    tokens = [m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    bare = [t.strip(marks).lower() for t in tokens]
    sentence, number = [], 0
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if k and (re.search(r"[.!?][\"')\]]?$", tokens[k - 1]) or "\n" in text[last : m.start()]):
            number += 1
        sentence.append(number)
        last = m.end()
    segments = list(zip(bare, sentence))
    for a, b in zip(range(len(bare)), range(1, len(bare))):
        x, y = bare[a], bare[b]
        unknown = any(w.encode() not in model.known for w in (x, y))
        if x and y and unknown and tokens[a][-1] not in ".,;:!?" and T.LEAST_JOINED <= len(x) + len(y) <= T.MOST_JOINED and min(len(x), len(y)) <= T.MOST_PIECE:
            segments.append((x + y, sentence[a]))
    k = 0
    while k < len(bare):
        n = next((j for j in range(k, len(bare)) if len(bare[j]) != 1), len(bare)) - k
        if 3 <= n <= T.RUN:
            segments.append(("".join(bare[k : k + n]), sentence[k]))
        k += max(n, 1)

    def vector(w):
        symbols = [0 if ord(c) >= 1 << 16 else int(T.TABLE[ord(c)]) for c in w]
        while symbols and not symbols[0]:
            symbols.pop(0)
        while symbols and not symbols[-1]:
            symbols.pop()
        symbols = [T.START, *symbols, T.END] if symbols else []
        v, square = {}, 0.0
        for i, j, l in itertools.combinations(range(len(symbols)), 3):
            if l < i + T.SPAN and symbols[i] and symbols[j] and symbols[l]:
                key, w_ = symbols[i] << 12 | symbols[j] << 6 | symbols[l], T.DECAY ** (l - i - 2)
                v[key], square = v.get(key, 0) + w_, square + w_**2
        return {t: x / max(square, 1.0) ** 0.5 for t, x in v.items()}

    most, near = {}, False
    for w, at in segments:
        v = vector(w)
        margin = sum(x * model.weights[t] for t, x in v.items()) + model.bias
        most[at] = max(most.get(at, 0), model.evidence[np.digitize(margin, T.BINS)])
        if model.telling and margin >= T.LOOK:
            rows = model.telling.landmarks
            kernel = sum((x * rows.rows[rows.row[t]] for t, x in v.items() if rows.row[t] >= 0), np.zeros(rows.rows.shape[1]))
            near |= bool((kernel > model.telling.reach).any())
    total = sum(most.values())
    features = [np.log1p(total), max(most.values(), default=0), total / max(len(most), 1) ** 0.5, float(near)]
    return 1 / (1 + np.exp(-(np.dot(features, model.coefficients[:-1]) + model.coefficients[-1])))


def test_score_by_plain_loops():
    data = rows(300)
    toxic = np.array([y == 1 for *_, y in data])
    model = T.fit([t for _, t, _ in data], toxic, np.ones(len(data)))
    assert model.telling is not None and len(model.known) > 10
    texts = [t for _, t, _ in rows(60, 8)] + ["you are an id iot here. the mo ron, no", "an i d i o t and X y z a. b, c", "clxown; ide al\nthe lan tern", "--idi.ot, \U0001f600🙂x é", "", "..."]
    assert np.allclose(T.Model.score(model, T.Bag(pa.array(texts, pa.large_string()), model.known)), [plain_score(model, t) for t in texts], atol=1e-4)


def test_disguised_in_long_texts():
    """Split, spaced, marked and lengthened insults within long clean texts; the same texts without them stay."""
    data = rows()
    model = T.fit([t for _, t, _ in data], np.array([y == 1 for *_, y in data]), np.ones(len(data)))
    score = lambda texts: model.score(T.Bag(pa.array(texts, pa.large_string()), model.known))
    host = next(t for _, t, y in rows(300, 17) if y == 0 and len(t.split()) > 100)
    put = lambda form: host.replace(" ", f" {form} ", 40).replace(f" {form} ", " ", 39)
    assert put("x").count(" x ") == 1 and score([host])[0] < 0.3
    forms = {w: [" ".join(w), ".".join(w), *(f"{w[:k]} {w[k:]}" for k in range(1, len(w)))] for w in ("idiot", "clown", "moron")}
    caught = [v >= T.THRESHOLD for fs in forms.values() for v in score([put(f) for f in fs])]
    assert np.mean(caught) >= 0.9
    longer = [f"{w[:k]}{c}{w[k:]}" for w in forms for k in range(1, len(w)) for c in "qxz"]
    assert np.mean(score([put(f) for f in longer]) >= T.THRESHOLD) >= 0.7


def rows(n=900, seed=3):
    rng = random.Random(seed)
    clean = ["the", "harbour", "lantern", "quietly", "marble", "of", "Winter", "carried", "é", "toward", "plain", "idea", "ideal", "crown"]
    bad = ["idiot", "clown", "moron"]
    out = []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "old") for i, t, _ in data] + [(5000, None, "old"), (5001, "", "old"), (5002, " i d i o t ", "old"), (5003, "you clo-wn", "old"), (5004, "the harbour " * 30_000, "old"), (0, data[0][1], "old")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels.filter(~T.held_out()))
    got = T.score(docs.withColumn("held_out", T.held_out()), model).collect()
    assert len(got) == len(data) + 6
    by = {r["doc_id"]: r for r in got}
    held = [(y, by[i]) for i, _, y in data if by[i]["held_out"]]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in data)
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert [by[i]["predicted"] for i in (5000, 5001, 5002, 5003, 5004)] == [0, 0, 1, 1, 0]
    assert by[5000]["score"] == by[5001]["score"]
    assert T.score(docs.limit(0), model).collect() == []
    named = T.score(docs, model, names=("s", "p"))
    assert named.columns == ["doc_id", "text", "score", "s", "p"] and {r["score"] for r in named.collect()} == {"old"}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert T.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).telling is None
    for labels in ([], [(1, 0)], [(1, 1)]):
        model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["predicted"] for r in T.score(docs, model).collect()} == {0}
    empty = T.Bag(pa.array([], pa.large_string()))
    assert empty.features(np.zeros(0), np.zeros(0, bool)).shape == (0, T.FEATURES)


def test_bag_in_parts():
    texts = [t for _, t, _ in rows(40)] + [None, "", "x " * 700_000] + [t for _, t, _ in rows(40, 9)]
    whole, parts = T.Bag(pa.array(texts, pa.large_string())), T.Bag.of(texts)
    assert sorted(set(whole.segments)) == sorted(parts.segments) and whole.n == parts.n
    named = lambda b: sorted(zip((b.segments[i] for i in b.segment), b.sentence.tolist(), b.owner[b.sentence].tolist()))
    assert named(whole) == named(parts) and (whole.first == parts.first).all()
