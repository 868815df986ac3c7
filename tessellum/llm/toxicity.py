"""Toxicity of texts: a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

Kernel: two strings are compared by the subsequences of three symbols that they share, each occurrence
weighted by DECAY for every symbol it skips, as far as it spans SPAN positions; the start and the end of
a word are symbols too. So inserted characters and gaps ("id.iot", "idxiot") lower a match and don't end
it. The segments of a sentence are its words, its letters set apart ("i d i o t") put together, and
neighbours put together ("id iot") where one is short and one is no word of clean documents. A segment's
kernel row against the landmarks, whitened by the landmarks' own kernel matrix, is what the machine is
trained on. As the kernel is a product of sparse vectors, the trained sum over landmarks folds into one
weight for each of 2**18 triples, and scoring a segment costs the same whatever their number.

Training: labels mark whole documents, so the sentences of toxic documents are labelled by rounds, in
which the segments that the last model finds most toxic stand for the document and the most toxic
ones of clean documents against it; the most telling segments also come with gaps and strange letters.
A sentence's margin is its worst segment's; its evidence is the log of how much more often toxic
documents reach such a margin than clean ones, measured on the half that a model was not trained on.
Segments of positive margin get a second look: whether the kernel with a telling segment (one of several
toxic documents and of no clean one) is higher than that of any segment of clean documents. A logistic
function of a document's summed, greatest and mean evidence and of that look is its score; it also learns
from clean documents with one telling segment put into them, disguised in turn. The sample is bounded: at
most MOST_TOXIC and MOST_CLEAN labelled documents of at most MOST_CHARS characters, those with the least
hashes of their ids, one text for each id. It is fitted in one task; only the model comes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import sliced
from tessellum.llm.span_dedup import Sentences

SPAN, DECAY, SYMBOLS = 7, 0.6, 64
LANDMARKS, ROUNDS = 300, 3
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 3000, 10_000
THRESHOLD = 0.7
TOP = 3
#: Disguises of each kind that a telling segment is trained in.
FORMS = 4
#: Joined neighbours have so many letters, the shorter one at most MOST_PIECE; letters set apart are read RUN at a time.
LEAST_JOINED, MOST_JOINED, MOST_PIECE, RUN = 3, 12, 4, 12
MARKS, STOPS = b".,;:!?\"'()[]*_-%&|$#<>", (b".", b",", b";", b":", b"!", b"?")
#: Telling segments stand in AGREE toxic documents and no clean one; MOST_TELLING of them are compared with segments of a margin from LOOK on.
AGREE, MOST_TELLING, LOOK = 5, 64, 0.2
#: Their reach: the highest kernel with a segment of clean documents and APART more, LEAST_REACH at least; beyond MOST_REACH they tell nothing.
APART, LEAST_REACH, MOST_REACH = 0.03, 0.45, 0.66
#: Clean documents of each half that get a telling segment, and their weight as a share of that of toxic ones.
PLANTED, PLANTED_SHARE = 200, 0.6
FEATURES = 4
START, END = 60, 63
#: Upper ends of the margins' bins.
BINS = np.linspace(-0.4, 1.4, 19)
CHUNK = 40_000


def symbol_table() -> np.ndarray:
    """Symbols of the code points below 65536: a-z, Latin letters with marks, digits, other letters; 0: none."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i).lower()
        if not c.isalnum():
            continue
        o = ord(c[0])
        if 97 <= o <= 122:
            table[i] = o - 96
        elif 0xE0 <= o <= 0xFF:
            table[i] = 27 + (o - 0xE0)
        elif c.isdigit():
            table[i] = 59
        else:
            table[i] = 61 + o % 2
    return table


TABLE = symbol_table()
OFFSETS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]


@dataclass
class Segments:
    """Symbols of segments in a row, each between START and END; zeros are other signs; `of` has each symbol's segment."""

    symbols: np.ndarray
    of: np.ndarray
    n: int

    @staticmethod
    def parse(segments: list[bytes]) -> Segments:
        if not segments:
            return Segments(np.zeros(0, np.uint32), np.zeros(0, np.int64), 0)
        points = np.frombuffer(b"\n".join(segments).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        line = points == 10
        symbols = np.where(points < 1 << 16, TABLE[np.minimum(points, 0xFFFF)], 62).astype(np.uint32)
        of = np.cumsum(line) - line
        # START goes before a segment's first letter, END after its last one; what stands outside of them falls out
        letter = np.flatnonzero(symbols > 0)
        if not len(letter):
            return Segments(np.zeros(0, np.uint32), np.zeros(0, np.int64), len(segments))
        edge = of[letter[1:]] != of[letter[:-1]]
        first, last = letter[np.concatenate(([True], edge))], letter[np.concatenate((edge, [True]))]
        change = np.zeros(len(symbols) + 1, np.int8)
        change[first], change[last + 1] = 1, -1
        within = np.cumsum(change[:-1]) > 0
        times = np.ones(len(symbols), np.int64)
        times[first] += 1
        times[last] += 1
        at = np.cumsum(times * within) - times * within
        symbols, of = np.repeat(symbols[within], times[within]), np.repeat(of[within], times[within])
        symbols[at[first]], symbols[at[last] + times[last] - 1] = START, END
        return Segments(symbols, of, len(segments))

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Subsequences by their offsets: (triples, their segments, weight)."""
        s, of, n = self.symbols, self.of, len(self.symbols)
        for i, j in OFFSETS:
            if n <= j:
                continue
            a, b, c = s[: n - j], s[i : n - j + i], s[j:]
            here = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (of[: n - j] == of[j:]))
            yield a[here] << np.uint32(12) | b[here] << np.uint32(6) | c[here], of[here], DECAY ** (j - 2)

    def norms(self) -> np.ndarray:
        total = np.zeros(self.n)
        for _, of, weight in self.triples():
            total += np.bincount(of, minlength=self.n) * weight**2
        return np.sqrt(np.maximum(total, 1.0))

    def weigh(self, table: np.ndarray) -> np.ndarray:
        """Each segment's product with a vector over triples, over the segment's length."""
        total, square = np.zeros(self.n), np.zeros(self.n)
        for triple, of, weight in self.triples():
            total += np.bincount(of, table[triple], self.n) * weight
            square += np.bincount(of, minlength=self.n) * weight**2
        return total / np.sqrt(np.maximum(square, 1.0))


def weigh(segments: list[bytes], table: np.ndarray) -> np.ndarray:
    """Each segment's product with a vector over triples, so many segments at a time as memory allows."""
    return np.concatenate([Segments.parse(segments[a : a + CHUNK]).weigh(table) for a in range(0, len(segments), CHUNK)] or [np.zeros(0)])


class Landmarks:
    """Landmarks by their triples: `rows` has a row for each triple that any of them has, `row` its number (-1: none)."""

    def __init__(self, names: list[bytes]):
        own = Segments.parse(names)
        triples = list(own.triples())
        known = np.unique(np.concatenate([t for t, _, _ in triples] or [np.zeros(0, np.uint32)]))
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.row[known] = np.arange(len(known))
        self.rows = np.zeros((len(known), len(names)), np.float32)
        norms = own.norms()
        for t, of, w in triples:
            np.add.at(self.rows, (self.row[t], of), w / norms[of])

    def kernel(self, segments: list[bytes]) -> np.ndarray:
        """The kernel of each segment with each landmark."""
        some = Segments.parse(segments)
        out = np.zeros((len(segments), self.rows.shape[1]), np.float32)
        for triple, of, w in some.triples():
            at = self.row[triple]
            here = np.flatnonzero(at >= 0)
            for x in range(0, len(here), 50_000):  # bounds the memory of the gathered rows
                part = here[x : x + 50_000]
                o = of[part]
                begin = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                out[o[begin]] += np.float32(w) * np.add.reduceat(self.rows[at[part]], begin, axis=0)
        return out / some.norms()[:, None].astype(np.float32)


@dataclass
class Telling:
    """Segments of several toxic documents and of no clean one, each with its reach: how like it clean segments get."""

    landmarks: Landmarks
    reach: np.ndarray

    @staticmethod
    def of(segments: list[bytes], margins: np.ndarray, n_bad: np.ndarray, n_good: np.ndarray) -> Telling | None:
        chosen = np.flatnonzero((n_bad >= AGREE) & (n_good == 0))
        chosen = chosen[np.argsort(-n_bad[chosen], kind="stable")][:MOST_TELLING]
        if not len(chosen):
            return None
        landmarks = Landmarks([segments[i] for i in chosen])
        clean = [segments[i] for i in np.flatnonzero((n_good > 0) & (margins >= LOOK))]
        reach = landmarks.kernel(clean).max(axis=0, initial=0.0) + APART
        landmarks.rows = landmarks.rows[:, reach <= MOST_REACH]
        return Telling(landmarks, np.maximum(reach[reach <= MOST_REACH], LEAST_REACH))

    def near(self, segments: list[bytes], margins: np.ndarray) -> np.ndarray:
        """Whether each segment is more like one of these than any clean segment. Only positive margins get this look."""
        out = np.zeros(len(segments), bool)
        look = np.flatnonzero(margins >= LOOK)
        for a in range(0, len(look), CHUNK // 4):
            part = look[a : a + CHUNK // 4]
            out[part] = (self.landmarks.kernel([segments[i] for i in part]) > self.reach).any(axis=1)
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    evidence: np.ndarray
    coefficients: np.ndarray
    known: frozenset[bytes]
    telling: Telling | None

    def margins(self, bag: Bag) -> np.ndarray:
        return weigh(bag.segments, self.weights) + self.bias

    def score(self, bag: Bag) -> np.ndarray:
        margins = self.margins(bag)
        near = self.telling.near(bag.segments, margins) if self.telling else np.zeros(len(margins), bool)
        features = bag.features(self.evidence[np.digitize(margins, BINS)], near)
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


class Bag:
    """Segments of a batch of texts: distinct ones, and for each occurrence its segment, sentence and text.

    known: short words that clean documents use; without it there are no joined neighbours."""

    def __init__(self, column: pa.Array, known: frozenset[bytes] | None = None):
        s = Sentences(column)
        buf = s.texts.buf
        sentence = np.repeat(np.arange(len(s.owner)), np.diff(s.word))
        _, at, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
        whole = [buf[a:b].tobytes() for a, b in zip(s.word_start[at].tolist(), s.word_end[at].tolist())]
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(x.strip(MARKS).lower(), len(number)) for x in whole), np.int64, len(whole))
        open_ = np.fromiter((x[-1:] not in STOPS for x in whole), bool, len(whole))[inverse]
        inverse = same[inverse]
        bare = self.segments = list(number)
        size = np.fromiter((len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in bare), np.int64, len(bare))
        parts, where = [], []
        text = np.repeat(np.arange(s.texts.n), np.diff(s.words))
        for a, b in runs((size == 1)[inverse], text):  # letters set apart, in windows of at most RUN letters
            for x in range(a, max(b - RUN, a) + 1, RUN // 3) if b - a > RUN else (a,):
                parts.append(b"".join(bare[i] for i in inverse[x : min(x + RUN, b)]))
                where.append(sentence[x])
        if known is not None and len(inverse):
            strange = np.fromiter((x not in known for x in bare), bool, len(bare))
            x, y = inverse[:-1], inverse[1:]
            fits = (strange[x] | strange[y]) & open_[:-1] & (size[x] > 0) & (size[y] > 0) & (size[x] + size[y] >= LEAST_JOINED) & (size[x] + size[y] <= MOST_JOINED) & (np.minimum(size[x], size[y]) <= MOST_PIECE) & (text[:-1] == text[1:])
            pairs = np.flatnonzero(fits)
            both, first, again = np.unique(x[pairs] * len(bare) + y[pairs], return_index=True, return_inverse=True)
            joined = len(bare) + again
            self.segments = bare + [bare[i] + bare[j] for i, j in zip((both // len(bare)).tolist(), (both % len(bare)).tolist())]
        else:
            pairs, joined = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.segment = np.concatenate((inverse, joined, len(self.segments) + np.arange(len(parts)))).astype(np.int64)
        self.segments = self.segments + parts
        self.sentence = np.concatenate((sentence, sentence[pairs], np.array(where, np.int64))).astype(np.int64)
        self.owner = s.owner
        self.first = s.first
        self.n = s.texts.n

    @staticmethod
    def of(texts: list[str | None], known: frozenset[bytes] | None = None) -> Bag:
        """A bag of many texts, put together from a few at a time."""
        parts, a, size = [], 0, 0
        for i, t in enumerate([*texts, None]):
            if i > a and (size > 1 << 20 or i == len(texts)):
                parts.append(Bag(pa.array(texts[a:i], pa.large_string()), known))
                a, size = i, 0
            size += len(t or "")
        if len(parts) == 1:
            return parts[0]
        out = Bag(pa.array([], pa.large_string()))
        number: dict[bytes, int] = {}
        for p in parts:
            ids = np.array([number.setdefault(x, len(number)) for x in p.segments], np.int64)
            out.segment = np.concatenate((out.segment, ids[p.segment]))
            out.sentence = np.concatenate((out.sentence, p.sentence + len(out.owner)))
            out.first = np.concatenate((out.first[:-1], p.first + len(out.owner)))
            out.owner = np.concatenate((out.owner, p.owner + out.n))
            out.n += p.n
        out.segments = list(number)
        return out

    def features(self, evidence: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each text, from the evidence of each segment: sum (its logarithm), greatest, and sum over the root of the number of sentences; and whether any segment is near a telling one."""
        most = np.zeros(len(self.owner))
        np.maximum.at(most, self.sentence, evidence[self.segment])
        total = np.bincount(self.owner, most, self.n)
        top = np.zeros(self.n)
        np.maximum.at(top, self.owner, most)
        close = np.bincount(self.owner[self.sentence], near[self.segment], self.n) > 0
        return np.column_stack((np.log1p(total), top, total / np.sqrt(np.maximum(np.diff(self.first), 1)), close))


def runs(flags: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of at least three flags within a text."""
    if not len(flags):
        return []
    new = np.flatnonzero(np.concatenate(([True], (flags[1:] != flags[:-1]) | (text[1:] != text[:-1]))))
    ends = np.append(new[1:], len(flags))
    return [(a, b) for a, b in zip(new.tolist(), ends.tolist()) if flags[a] and b - a > 2]


def short_words(texts: list[str | None]) -> frozenset[bytes]:
    """The words of so many letters that they can be a piece of joined neighbours."""
    found = {x.strip(MARKS).lower() for t in texts if t for x in set(t.encode().split())}
    return frozenset(x for x in found if len(x.decode("utf-8", "replace")) <= MOST_JOINED)


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps; the bias is hardly penalised."""
    z = np.column_stack((x, np.ones(len(x))))
    keep = np.full(z.shape[1], penalty)
    keep[-1] = penalty * 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        a = z[active] * weight[active, None]
        new = np.linalg.solve(z[active].T @ a + np.diag(keep), a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    keep = np.diag([*[penalty] * x.shape[1], 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(z.T @ (z * h[:, None]) + keep, z.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_of(owner: np.ndarray, segment: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (owner, segment), the k of each owner with the highest scores."""
    order = np.lexsort((segment, -score[segment], owner))
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    return o[rank < k], segment[order][rank < k]


def disguised(segment: bytes, rng: np.random.Generator) -> list[bytes]:
    """A segment with marks at every letter, with one mark, and with one and two strange letters within."""
    word = segment.decode("utf-8", "replace").strip(MARKS.decode())
    if len(word) < 3:
        return []
    cut = lambda: int(rng.integers(1, len(word)))
    strange = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(26, size=n))
    out = [" ".join(word), ".".join(word), *(f"{word[:k]}-{word[k:]}" for k in (cut(),))]
    for n in (1, 2):
        out += [f"{word[:k]}{strange(n)}{word[k:]}" for k in (cut() for _ in range(FORMS))]
    return [x.encode() for x in out]


def separate(segments: list[bytes], doc: np.ndarray, segment: np.ndarray, toxic: np.ndarray, seed: int) -> tuple[np.ndarray, float] | None:
    """Weights of triples and a bias, from pairs (document, segment) and the documents' labels; None without both kinds."""
    bad = toxic[doc]
    if bad.all() or not bad.any():
        return None
    n = len(segments)
    in_toxic, in_clean = (np.bincount(segment[bad == kind], minlength=n) for kind in (True, False))
    counts = np.zeros((2, SYMBOLS**3))
    for a in range(0, n, CHUNK):
        for triple, of, w in Segments.parse(segments[a : a + CHUNK]).triples():
            for k, c in enumerate((in_toxic, in_clean)):
                counts[k] += np.bincount(triple, c[a + of] * w, SYMBOLS**3)
    share = counts.sum(axis=0) / counts.sum()
    prior = 3.0 * counts.sum(axis=1) / counts.sum()
    odds = np.log((counts[0] + prior[0] + 1e-9) / (counts[0].sum() + prior[0])) - np.log((counts[1] + prior[1] + 1e-9) / (counts[1].sum() + prior[1]))
    score = weigh(segments, np.where(share > 0, odds, 0.0))
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        chosen = [best_of(doc[bad == kind], segment[bad == kind], score, TOP) for kind in (True, False)]
        random = segment[rng.random(len(segment)) < min(1, 6000 / len(segment))]
        random = random[in_clean[random] > 0]
        positive = np.bincount(chosen[0][1], minlength=n).astype(float)
        negative = np.bincount(chosen[1][1], minlength=n).astype(float) + np.bincount(random, minlength=n)
        # a segment that stands for toxic documents has its clean documents against it, all of them
        negative = np.maximum(negative, np.where(positive > 0, in_clean, 0))
        # what stands for one document may be chance: its weight grows with the documents that agree and falls with those that don't
        positive = positive * positive / np.maximum(positive + 2 * negative, 1)
        used = np.flatnonzero((positive > 0) | (negative > 0))
        names, positive, negative = [segments[i] for i in used], positive[used], negative[used]
        telling = np.argsort(-(positive - 2 * negative), kind="stable")
        hard = np.argsort(-(negative * (1 + np.maximum(score[used], 0))), kind="stable")
        forms: list[int] = []
        for i in telling[:100]:
            if positive[i] > 2 * negative[i] + 1:
                extra = disguised(names[i], rng)
                forms += range(len(names), len(names) + len(extra))
                names += extra
                positive = np.append(positive, [positive[i] / 4] * len(extra))
                negative = np.append(negative, [0.0] * len(extra))
        quarter = LANDMARKS // 4
        marks = np.unique(np.concatenate((telling[:quarter], rng.permutation(forms)[:quarter], hard[:quarter], rng.permutation(len(used))[:quarter])).astype(np.int64))
        landmark = Segments.parse([names[i] for i in marks])
        known = np.unique(np.concatenate([t for t, _, _ in landmark.triples()] or [np.zeros(0, np.uint32)]))
        if not len(known):
            return None
        column = np.full(SYMBOLS**3, -1)
        column[known] = np.arange(len(known))
        z = np.zeros((len(known), len(marks)), np.float32)
        norms = landmark.norms()
        for triple, of, w in landmark.triples():
            np.add.at(z, (column[triple], of), w / norms[of])
        values, vectors = np.linalg.eigh((z.T @ z).astype(float))
        good = values > 1e-4 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        rows = np.zeros((len(names), len(marks)), np.float32)
        x = Segments.parse(names)
        for triple, of, w in x.triples():
            at = column[triple]
            for a in range(0, len(at), 50_000):  # bounds the memory of the gathered rows
                c, o = at[a : a + 50_000], of[a : a + 50_000]
                c, o = c[c >= 0], o[c >= 0]
                if len(o):
                    begin = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                    rows[o[begin]] += np.add.reduceat(z[c] * np.float32(w), begin, axis=0)
        phi = (rows / x.norms()[:, None]) @ whiten
        sides = [np.flatnonzero(positive > 0), np.flatnonzero(negative > 0)]
        y = np.repeat([1.0, -1.0], [len(i) for i in sides])
        mass = np.concatenate((positive[sides[0]], negative[sides[1]])) ** 0.5
        for kind in (1, -1):
            mass[y == kind] *= len(y) / 2 / mass[y == kind].sum()
        w, bias = machine(phi[np.concatenate(sides)], y, mass, penalty=1.0)
        weights = np.zeros(SYMBOLS**3)
        weights[known] = z @ (whiten @ w)
        score = weigh(segments, weights) + bias
    return weights, bias


def evidence_of(margin: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each bin of margins: log of its share in toxic over its share in clean documents, at least 0, never falling.

    Bins that no training document has lie in between their neighbours."""
    bins = np.digitize(margin, BINS)
    toxic, clean = (np.bincount(bins[bad == kind], weight[bad == kind], len(BINS) + 1) for kind in (True, False))
    base = (toxic + clean) / max((toxic + clean).sum(), 1)
    odds = np.log((toxic + 2 * base + 1e-9) / (toxic.sum() + 2)) - np.log((clean + 2 * base + 1e-9) / (clean.sum() + 2))
    seen = np.flatnonzero(toxic + clean > 0)
    if len(seen):
        odds = np.interp(np.arange(len(odds)), seen, odds[seen])
    return np.maximum.accumulate(np.clip(odds, 0, 8))


def planted(texts: list[str], segments: list[bytes], rng: np.random.Generator) -> list[str]:
    """Each text with one of the segments put into it: as it is, in letters, in two parts, or with a letter more."""
    out = []
    for k, t in enumerate(texts):
        word = segments[int(rng.integers(len(segments)))].decode("utf-8", "replace").strip(MARKS.decode())
        cut = int(rng.integers(1, max(2, len(word))))
        form = [word, " ".join(word), f"{word[:cut]} {word[cut:]}", f"{word[:cut]}{chr(97 + int(rng.integers(26)))}{word[cut:]}"][k % 4]
        blanks = [i for i, c in enumerate(t) if c == " "]
        at = blanks[int(rng.integers(len(blanks)))] if blanks else len(t)
        out.append(f"{t[:at]} {form}{t[at:]}")
    return out


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """weight: how many documents each one stands for. Without both kinds, a model that scores all texts low and alike."""
    none = Model(np.zeros(SYMBOLS**3, np.float32), -1.0, np.zeros(len(BINS) + 1), np.array([*[0.0] * FEATURES, -2.0]), frozenset(), None)
    words = lambda those: short_words([texts[i] for i in np.flatnonzero(those & ~toxic)])
    bag = Bag.of(texts)
    pairs = np.unique(bag.owner[bag.sentence] << 32 | bag.segment)
    doc, segment = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(doc) or (whole := separate(bag.segments, doc, segment, toxic, 7)) is None:
        return none
    judged, margins, bad, heavy = [], [], [], []
    rng = np.random.default_rng(5)
    halves = [np.arange(len(texts)) % 2 == k for k in (0, 1)]
    for half in halves:  # each half is judged by what the other one teaches
        part = separate(bag.segments, doc[half[doc]], segment[half[doc]], toxic, 11) or whole
        rest = np.flatnonzero(~half)
        known = words(half)
        # segments of several toxic documents and of no clean one, planted in clean texts of the judged half
        n_bad, n_good = (np.bincount(segment[half[doc] & (toxic[doc] == kind)], minlength=len(bag.segments)) for kind in (True, False))
        own = weigh(bag.segments, part[0]) + part[1]
        telling = Telling.of(bag.segments, own, n_bad, n_good)
        hosts = rest[~toxic[rest]][:PLANTED]
        more = planted([texts[i] or "" for i in hosts], [bag.segments[i] for i in np.flatnonzero((n_bad >= AGREE) & (n_good == 0))], rng) if telling else []
        seen = Bag.of([*(texts[i] for i in rest), *more], known)
        scored = weigh(seen.segments, part[0]) + part[1]
        once = np.unique(seen.owner[seen.sentence] << 32 | seen.segment)
        once = once[once >> 32 < len(rest)]
        judged.append((rest, seen, scored, telling.near(seen.segments, scored) if telling else np.zeros(len(scored), bool)))
        margins.append(scored[once & 0xFFFFFFFF])
        bad.append(toxic[rest[once >> 32]])
        heavy.append(weight[rest[once >> 32]])
    evidence = evidence_of(np.concatenate(margins), np.concatenate(bad), np.concatenate(heavy))
    features, label, mass = [], [], []
    for rest, seen, scored, near in judged:
        features.append(seen.features(evidence[np.digitize(scored, BINS)], near))
        extra = seen.n - len(rest)
        label += [toxic[rest], np.ones(extra, bool)]
        mass += [weight[rest], np.full(extra, PLANTED_SHARE * weight[toxic].sum() / 2 / max(extra, 1))]
    n_bad, n_good = (np.bincount(segment[toxic[doc] == kind], minlength=len(bag.segments)) for kind in (True, False))
    telling = Telling.of(bag.segments, weigh(bag.segments, whole[0]) + whole[1], n_bad, n_good)
    coefficients = logistic(np.concatenate(features), np.concatenate(label).astype(float), np.concatenate(mass))
    return Model(whole[0].astype(np.float32), whole[1], evidence, coefficients, words(toxic | ~toxic), telling)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of docs that labels (id, label 0 or 1) cover. Null labels are left out;
    an id with labels of both kinds counts as toxic; of several texts with one id the one with the least
    hash is taken. Empty tables, and labels of one kind, give a model that scores all texts low and alike."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("__toxic"))
    total = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    order = [F.xxhash64("__id"), F.col("__id")]
    parts = [known.filter(F.col("__toxic") == kind).orderBy(*order).limit(most) for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = F.broadcast(spark.createDataFrame([tuple(r) for p in parts for r in p.collect()], known.schema))
    found = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).filter(F.length("__text") <= MOST_CHARS).join(sample, "__id")
    rows = found.groupBy("__id", "__toxic").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sampled = sorted((r["__id"], r["__text"], r["__toxic"]) for b in batches for r in b.to_pylist())
        toxic = np.array([t == 1 for _, _, t in sampled], bool)
        weight = np.ones(len(sampled))
        for kind in (True, False):
            weight[toxic == kind] = total.get(int(kind), 0) / max((toxic == kind).sum(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in sampled], toxic, weight))], pa.binary())], ["model"])

    model = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model["model"]) if model else fit([], np.zeros(0, bool), np.zeros(0))  # without rows there may be no task


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score (0 to 1) and whether it reaches the threshold (1 or 0), in columns of the given names.

    Every whole text is scored; null and empty texts score as texts without sentences. Rows that repeat
    stay; columns of docs that are named like the new ones are replaced. An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*(set(names) - {id, text}))
    columns, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m: Model = shared.value
        for batch in sliced(batches, text):
            value = m.score(Bag(batch.column(at), m.known))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], [*columns, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id's decimal text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))
