"""Document quality: base rules, then a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into BUCKETS buckets and counted over the trusted target and over
the raw corpus, all documents of each. A document's score is the sum of log(p_target / p_raw) over its
n-grams, divided by their number. Its own n-grams are left out of both counts, so a trusted document is
scored as if it had not been trusted, and a corpus of any size gives trusted and other documents scores
of one kind. The target is smoothed by the raw corpus: PRIOR n-grams of it are added, dealt as there.

The threshold is the score that TAIL of the trusted documents miss, of those that pass the base rules;
it is read off exact counts of scores in steps of 1 / STEPS, so it is the same in every run.

The counts that come to the driver, and the tables sent back, have one row for each bucket. Texts are
shuffled only where their ids may be trusted: a bitmap of fixed size, made of the trusted ids, lets all
of those through and few others, and the join of ids decides. However many ids there are, it only gets
less selective.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, sliced, turn_to
from tessellum.llm.textvec import SPACE, Texts, mix, owner, prefix, ranges, spans_hashed

BUCKETS = 1 << 16
#: n-grams of the raw corpus that smooth the target; the share of trusted documents below the threshold; steps of a score of 1.
PRIOR, TAIL, STEPS = 20_000, 0.02, 1000
#: Bits of the map of trusted ids: 8 MB.
BITS = 1 << 26
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def per_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    """How many flagged bytes each text has."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[texts.end] - total[texts.start[:-1]]


def repeats(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (group, key): which have an equal one in the group, and how many of each group aren't the first of their kind."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(n, np.int64)
    mixed = keys ^ mix(group.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mixed)
    same = (mixed[order][1:] == mixed[order][:-1]) & (group[order][1:] == group[order][:-1])
    twin = np.zeros(len(keys), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    return twin, np.bincount(group[order[1:][same]], minlength=n)


class Counted:
    """Words of a batch of texts with the base counts of each text."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        n = texts.n
        start, end, self.first = texts.words(~SPACE)
        self.hash = spans_hashed(texts.buf, start, end)
        self.owner = owner(self.first)
        self.n_words = np.diff(self.first)
        inside = ~SPACE[texts.buf]
        self.word_chars = per_text(inside & (texts.buf & 0xC0 != 0x80), texts)
        self.n_symbols = per_text(SYMBOLS[texts.buf], texts)
        line_end = np.flatnonzero(texts.buf == 10)
        line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
        full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        line_start, line_end = line_start[full], line_end[full]
        self.n_dup_lines = repeats(spans_hashed(texts.buf, line_start, line_end), np.searchsorted(texts.start, line_start, side="right") - 1, n)[1]
        windows = np.flatnonzero(np.arange(len(start)) + WINDOW <= self.first[1:][self.owner])
        twin, _ = repeats(ranges(prefix(self.hash), windows, windows + WINDOW), self.owner[windows], n)
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, windows[twin], 1)
        np.add.at(edge, windows[twin] + WINDOW, -1)
        self.n_repeat_words = np.bincount(self.owner[np.cumsum(edge[:-1]) > 0], minlength=n)

    def ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words and pairs of neighbouring words, and the text of each."""
        pair = np.flatnonzero(self.owner[1:] == self.owner[:-1]) if len(self.owner) else np.zeros(0, np.int64)
        both = mix(self.hash[pair] * np.uint64(3) + self.hash[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
        mask = np.uint64(BUCKETS - 1)
        return np.concatenate((self.hash & mask, both & mask)).astype(np.int64), np.concatenate((self.owner, self.owner[pair]))


def count_rows(texts: DataFrame) -> DataFrame:
    """Rows (bucket, n) of all n-grams of the one column of texts."""

    name = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches, name):
            total += np.bincount(Counted(batch.column(0)).ngrams()[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(rows: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    found = rows.toPandas()  # one row for each bucket at most
    out[found["bucket"]] = found["n"]
    return out


def bitmap(ids: DataFrame) -> np.ndarray:
    """A map of BITS bits in 64-bit words, with the bit of each id's hash set; one row for each word comes to the driver at most."""
    at = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITS))
    rows = ids.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["word"]] = rows["bits"]
    return out.view(np.uint64)


def trusted_texts(docs: DataFrame, known: DataFrame, id: str, text: str) -> DataFrame:
    """The texts of docs whose id is in known (__id); only those that the bitmap lets through are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(known))
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), F.pmod(F.xxhash64(id), F.lit(BITS)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        turn_to("")
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(hit == 1))

    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, __text string").join(known.hint("merge"), "__id", "left_semi").select("__text")  # never broadcast: the ids grow with docs


class Ratios:
    """log(p_target / p_raw) of a text's n-grams, without the text's own part in the counts."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target, self.n_raw, self.n_target = raw, target, raw.sum(), target.sum()

    def mean(self, bucket: np.ndarray, which: np.ndarray, n: int, own: bool) -> np.ndarray:
        """The mean of each text 0 to n - 1. own: the texts are in the target too."""
        if not self.n_target:
            return np.zeros(n)
        pairs, times = np.unique(which << 16 | bucket, return_counts=True)
        b, t = pairs & 0xFFFF, pairs >> 16
        length = np.bincount(t, times, n)
        share = (np.maximum(self.raw[b] - times, 0) + 1) / (np.maximum(self.n_raw - length, 0) + BUCKETS)[t]
        mine, less = (self.target[b] - times, length) if own else (self.target[b], np.zeros(n))
        ratio = np.log((np.maximum(mine, 0) / share + PRIOR) / (np.maximum(self.n_target - less, 0) + PRIOR)[t])
        return np.bincount(t, times * ratio, n) / np.maximum(length, 1)


def judge(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", threshold: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    trusted: the ids of trusted documents (repeated and null ids count for nothing more). Null and
    empty texts have no words and fail the base rules; repeated rows are judged alike; other columns
    of docs are left out; an empty table gives no rows. Without any trusted text the scores are 0 and
    what passes the base rules is kept. threshold: in place of the one that the trusted documents set.
    scratch: takes the table that the result reads; without it that table stays."""
    spark = docs.sparkSession
    known = trusted.select(F.col(id).alias("__id")).filter("__id is not null").distinct()
    ratios = Ratios(dense(count_rows(docs.select(text))), dense(count_rows(trusted_texts(docs, known, id, text))))
    shared = spark.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, text):
            c = Counted(batch.column(1))
            grams, n = c.ngrams(), batch.num_rows
            failed = (c.n_words < 20) | (100 * c.n_repeat_words > 30 * c.n_words)
            scores = [np.round(shared.value.mean(*grams, n, own) * STEPS) / STEPS for own in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(getattr(c, x).astype(np.int64)) for x in names), pa.array(failed), *map(pa.array, scores)], [id, *names, "base_failed", "score", "own"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, " + "".join(f"{x} long, " for x in names) + "base_failed boolean, score double, own double")
    marked = rows.join(known.withColumn("__trusted", F.lit(True)).hint("merge"), F.col(id) == F.col("__id"), "left")
    scored = (scratch or Scratch(spark))(marked.select(id, *names, "base_failed", F.when(F.col("__trusted"), F.col("own")).otherwise(F.col("score")).alias("score"), F.coalesce("__trusted", F.lit(False)).alias("trusted")), "scored")
    if threshold is None:
        threshold = cut(scored.filter("trusted and not base_failed"))
    return scored.select(id, *names, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def cut(scored: DataFrame) -> float:
    """The greatest step that at most TAIL of the scores are below; without scores, one that all reach.

    Scores are means of bounded ratios, so the steps that come to the driver are bounded in number."""
    steps = scored.groupBy(F.round(F.col("score") * STEPS).cast("long").alias("step")).count().orderBy("step").collect()
    total, below = sum(r["count"] for r in steps), 0
    for r in steps:
        below += r["count"]
        if below > TAIL * total:
            return r["step"] / STEPS
    return -1e9
