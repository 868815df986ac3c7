"""Substring dedup over sliding sentence spans.

A sentence ends with . ! ? (or their full-width forms) or with a line. From every sentence on, and up
to every sentence, the shortest run of at least SENTENCES sentences and WORDS words is a span; so every
sentence of a repeated passage with as many words lies in a span within the passage.

A passage may also stand in the middle of a sentence, as one long sentence, or as whole sentences too
short for a span between two parts of sentences. One piece of it then lies in a sentence of LONG words or more, so windows of WORDS
words that touch such a sentence are spans too, wherever sentences begin. Of every REACH windows in a
row the one with the least hash is taken, which makes the choice one of the words alone: a passage of
WORDS + REACH - 1 words has a window in all its places, and windows leave at most REACH - 1 words at
either end. Windows of fewer than DISTINCT words (rules, one word over and over) are left out.

Spans are 96-bit hashes of their words. Of the documents that share a span, the first is the one with
the least id; there the span's first place stays. Words in any other place of a repeated span are removed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, sliced
from tessellum.llm.textvec import SPACE, Texts, U, mix, prefix, ranges, spans_hashed

SENTENCES, WORDS = 2, 20
LONG, REACH, DISTINCT = 16, 13, 5
END = np.zeros(256, bool)
END[list(b".!?")] = True
CLOSING = np.zeros(256, bool)
CLOSING[list(b"\"')]")] = True


def rolling(best: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """best of x[i : i + n] for every i that has as many."""
    size = 1
    while 2 * size <= n:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (n - size)], x[n - size :])


class Sentences:
    """Sentences of a batch of texts: from word[i] to word[i + 1] in words of the batch, first[t] the first of text t.

    words[t] is the first word of text t."""

    def __init__(self, column: pa.Array):
        t = self.texts = Texts(column)
        b = t.buf
        wide = np.zeros(len(b), bool)  # the last byte of a full-width full stop, exclamation or question mark
        if len(b) > 2:
            wide[2:] = (b[:-2] == 0xE3) & (b[1:-1] == 0x80) & (b[2:] == 0x82) | (b[:-2] == 0xEF) & (b[1:-1] == 0xBC) & ((b[2:] == 0x81) | (b[2:] == 0x9F))
        inside = ~SPACE[b]
        before = np.concatenate(([False], (inside & ~wide)[:-1])) if len(b) else inside
        after = np.concatenate((inside[1:], [False])) if len(b) else inside
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & (~after | wide)) + 1
        words = self.words = np.searchsorted(start, t.start)
        self.hash = spans_hashed(b, start, end)
        self.word_start, self.word_end = start, end
        new = np.zeros(len(start), bool)
        if len(start):
            new[words[:-1][words[:-1] < words[1:]]] = True
            lines = np.cumsum(b == 10, dtype=np.int32)
            last = b[end - 1]
            stops = END[last] | wide[end - 1] | CLOSING[last] & END[b[np.maximum(end - 2, 0)]]
            new[1:] |= stops[:-1] | (lines[start[1:]] != lines[end[:-1] - 1])
        self.word = np.append(np.flatnonzero(new), len(start))
        self.first = np.searchsorted(self.word[:-1], words)
        self.owner = np.repeat(np.arange(t.n), np.diff(self.first))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans as first and last sentence."""
        n = len(self.owner)
        at = np.arange(n)
        last = np.maximum(np.searchsorted(self.word[1:], self.word[:-1] + WORDS), at + SENTENCES - 1)
        first = np.minimum(np.searchsorted(self.word[:-1], self.word[1:] - WORDS, side="right") - 1, at - SENTENCES + 1)
        ahead = last < self.first[1:][self.owner]
        back = first >= self.first[:-1][self.owner]
        pairs = np.unique(np.concatenate((at[ahead] << 32 | last[ahead], first[back] << 32 | at[back])))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def windows(self) -> np.ndarray:
        """First words of the windows that are spans."""
        n = len(self.hash) - WORDS + 1
        if n < REACH:
            return np.zeros(0, np.int64)
        at = np.arange(n)
        value = ranges(prefix(self.hash), at, at + WORDS)
        least = rolling(np.minimum, value, REACH)
        owner = np.repeat(np.arange(self.texts.n), np.diff(self.words))
        least[owner[: len(least)] != owner[WORDS + REACH - 2 :]] = 0
        edge = np.zeros(REACH - 1, U)
        taken = np.flatnonzero(rolling(np.maximum, np.concatenate((edge, least, edge)), REACH) == value)
        lengths = np.diff(self.word)
        long = np.concatenate(([0], np.cumsum(np.repeat(lengths >= LONG, lengths))))
        taken = taken[long[taken + WORDS] > long[taken]]
        of = np.sort(self.hash[taken[:, None] + np.arange(WORDS)], axis=1)
        return taken[(of[:, 1:] != of[:, :-1]).sum(axis=1) >= DISTINCT - 1]


def spans(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (h, c, doc_id, text_key, span, again): hashes, the text's hash, the place in the text, whether the text has had it.

    The place is first << 32 | last sentence, and ~(first << 32 | last word) of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, text):
            s = Sentences(batch.column(1))
            first, last = s.spans()
            window = s.windows()
            mine = np.concatenate((s.owner[first], np.searchsorted(s.words, window, side="right") - 1))
            a, b = np.concatenate((s.word[first], window)), np.concatenate((s.word[last + 1], window + WORDS))
            kind = np.repeat(np.array([0, 0x5851F42D4C957F2D], U), (len(first), len(window)))
            h = mix(ranges(prefix(s.hash), a, b) ^ kind)
            c = ranges(prefix(mix(s.hash ^ U(0xA5A5A5A5A5A5A5A5))), a, b)
            order = np.lexsort((a, h ^ mix(mine.astype(U) + U(1))))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (mine[order[1:]] == mine[order[:-1]])
            base, begin = s.first[mine[: len(first)]], window - s.words[mine[len(first) :]]
            place = np.concatenate(((first - base) << 32 | (last - base), ~(begin << 32 | (begin + WORDS - 1))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array((c >> U(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(pa.array(mine)), batch.column(2).take(pa.array(mine)), pa.array(place), pa.array(again)],
                ["h", "c", "doc_id", "text_key", "span", "again"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text, F.xxhash64(text)).mapInArrow(run, f"h long, c int, doc_id {kind}, text_key long, span long, again boolean")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, counts: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """docs with the repeated spans cut out of `text`, and two counts: all sentences, and those that lose words.

    The space after removed words goes with them; a text that ends with removed ones loses the space
    before them too. Texts without a whole span, null and empty ones included, stay as they are.
    Rows that share an id are taken for one document: nothing is removed between them, and what is cut
    from one leaves rows of other texts as they are. Rows with null ids are a document for each text;
    they come last, those with the least hash of their text first. Columns of docs that are named like
    the counts are replaced. An empty table stays empty. scratch: takes the table of cuts, which the
    result reads; without it that table stays."""
    own = Scratch(docs.sparkSession) if scratch is None else scratch
    found = spans(docs, id, text)
    least_key = F.min(F.when(F.col("doc_id").isNull(), F.col("text_key"))).alias("least_key")
    repeated = own(found.groupBy("h", "c").agg(F.min("doc_id").alias("least_id"), least_key, F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    other = F.when(F.col("doc_id").isNull(), F.col("least_id").isNotNull() | (F.col("text_key") != F.col("least_key"))).otherwise(F.col("doc_id") != F.col("least_id"))
    later = found.join(repeated, ["h", "c"]).filter(F.col("again") | other)
    cut = own(later.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("span").alias("__spans")), "cut")
    own.drop("repeated")
    rows = docs.drop(*(set(counts) - {id, text}))
    joined = rows.join(cut, rows[id].eqNullSafe(cut["__id"]) & (F.xxhash64(rows[text]) == cut["__key"]), "left").drop("__id", "__key")
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, text):
            s = Sentences(batch.column(at))
            sentences = np.diff(s.first)
            out, removed = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for i, cuts in enumerate(batch.column(len(names)).to_pylist()):
                if not cuts:
                    continue
                words = s.word[s.first[i] : s.first[i + 1] + 1] - s.words[i]
                packed = np.array(cuts, np.int64)
                window = packed < 0
                packed = np.where(window, ~packed, packed)
                begin, end = packed >> 32, (packed & 0xFFFFFFFF) + 1
                fits = end <= np.where(window, words[-1], sentences[i])
                begin, end, window = begin[fits], end[fits], window[fits]
                edge = np.zeros(words[-1] + 1, np.int64)
                np.add.at(edge, np.concatenate((begin[window], words[begin[~window]])), 1)
                np.add.at(edge, np.concatenate((end[window], words[end[~window]])), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed[i] = np.logical_or.reduceat(gone, words[:-1]).sum()
                buf, a, b = s.texts.buf, s.texts.start[i], s.texts.end[i]
                starts = np.append(s.word_start[s.words[i] : s.words[i + 1]], b)
                change = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).view(np.int8)))
                whole = buf[a : starts[0]].tobytes() + b"".join(buf[starts[x] : starts[y]].tobytes() for x, y in zip(change[::2], change[1::2]))
                out[i] = (whole.rstrip(b" \t\n\r\v\f") if gone[-1] else whole).decode()
            columns = [pa.array(out, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sentences.astype(np.int64)), pa.array(removed)], [*names, *counts])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return joined.mapInArrow(run, f"{kinds}, `{counts[0]}` long, `{counts[1]}` long")
