"""Benchmark passages in training documents, found in a positional inverted index.

The index is cut by documents: each shard has the sorted terms of some documents, where each term's
list begins, and the positions of every token, in order. Positions of neighbouring documents are GAP
apart, so that no phrase runs from one into the next. A phrase is looked up in each shard from its
rarest term on: lists are shifted by the term's place in the phrase and intersected, the rarest first,
until none is left or all agree. Nothing is shuffled; no list leaves its shard. The phrases of the
benchmark are a table of blocks, each of about BLOCK_BYTES of text; tasks read one block after the other
against the shards at hand, so neither the driver nor a broadcast holds them, however many there are.

Words: A-Z in lower case, then runs of digits, a-z and all that is not ASCII. Terms are 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessellum.llm.common import CACHES, Scratch, sliced, store, turn_to
from tessellum.llm.textvec import ALNUM, Texts, spans_hashed

GAP = 64
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 1 << 21
#: Bytes of shards that a task holds while it reads the blocks, and of blocks that a worker keeps for its next shards.
HELD_BYTES = 1 << 25


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    texts = Texts(column, fold=True)
    start, end, first = texts.words(ALNUM)
    return spans_hashed(texts.buf, start, end), first


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Write the index of whole texts: a row for each shard. Null or empty texts have no words; repeated
    rows stay; ids are of any type. Other columns are left out; an empty table gives an empty index."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(sliced(batches, text, SHARD_BYTES)):
            terms, first = hashed_words(batch.column(1))
            position = np.arange(len(terms)) + np.repeat(np.arange(batch.num_rows) * GAP, np.diff(first))
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            new = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{n}"]),
                    *(pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in (0, 2)),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (first.astype("<u4"), terms[new].astype("<u8"), np.append(new, len(terms)).astype("<u4"), position[order].astype("<u4"))),
                ],
                ["shard", "doc_ids", "text_keys", "first", "terms", "bounds", "postings"],
            )

    rows = docs.select(id, text, F.xxhash64(text)).mapInArrow(run, f"shard string, doc_ids array<{kind}>, text_keys array<long>, first binary, terms binary, bounds binary, postings binary")
    return (scratch or Scratch(docs.sparkSession))(rows, "postings")


@dataclass
class Phrases:
    """Windows of items: the item of each, its length, and its terms as numbers into `terms` (-1: none)."""

    item: list
    length: np.ndarray
    term: np.ndarray
    terms: np.ndarray

    @staticmethod
    def of(items: list[tuple], window: int) -> Phrases:
        hashes, first = hashed_words(pa.array([t for _, t in items], pa.large_string()))
        rows, owners, lengths = [], [], []
        for (item, _), a, b in zip(items, first, first[1:]):
            if a == b:
                continue
            n = min(window, b - a)
            views = np.lib.stride_tricks.sliding_window_view(hashes[a:b], n)
            rows.append(np.pad(views, ((0, 0), (0, window - n))))
            owners += [item] * len(views)
            lengths += [n] * len(views)
        length = np.array(lengths, np.int64)
        table = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        terms, term = np.unique(table, return_inverse=True)
        return Phrases(owners, length, np.where(np.arange(window) < length[:, None], term.reshape(table.shape), -1), terms)


class Shard:
    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.first = np.frombuffer(row["first"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.bounds = np.frombuffer(row["bounds"], "<u4").astype(np.int64)
        self.postings = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        self.base = self.first[:-1] + np.arange(len(self.doc_ids)) * GAP

    def counts(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's list begins, and its length (0: not here)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        return self.bounds[at], np.where(here, self.bounds[at + 1] - self.bounds[at], 0)

    def live(self, p: Phrases) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Phrases with all terms here: (number, [(place in the phrase, list)], the rarest first)."""
        begin, count = self.counts(p.terms)
        table = np.where(p.term >= 0, count[p.term], np.iinfo(np.int64).max)
        for w in np.flatnonzero(table.min(axis=1, initial=np.iinfo(np.int64).max) > 0) if len(table) else []:
            places = np.argsort(table[w], kind="stable")[: p.length[w]]
            yield w, [(int(j), self.postings[begin[t] : begin[t] + count[t]]) for j in places for t in [p.term[w, j]]]

    def exact(self, p: Phrases) -> Iterator[tuple[int, np.ndarray]]:
        """Phrases that occur: (number, positions of their first words)."""
        for w, lists in self.live(p):
            starts = lists[0][1] - lists[0][0]
            for j, found in lists[1:]:
                at = np.minimum(np.searchsorted(found, starts + j), len(found) - 1)
                starts = starts[found[at] == starts + j]
                if not len(starts):
                    break
            if len(starts):
                yield w, starts

    def near(self, p: Phrases, span: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Phrases whose terms all occur, in any order, within `span` words: (number, [(first, last position)]).

        A shortest range is given for each occurrence of the rarest term."""
        for w, lists in self.live(p):
            needed: dict[int, tuple[int, np.ndarray]] = {}
            for j, found in lists:  # a term that stands twice in the phrase has to occur twice
                term = int(p.term[w, j])
                needed[term] = (needed.get(term, (0, found))[0] + 1, found)
            hits = set()
            for at in lists[0][1]:
                around = sorted((int(x), t) for t, (_, found) in needed.items() for x in found[np.searchsorted(found, at - span + 1) : np.searchsorted(found, at + span)])
                best, left, have = None, 0, dict.fromkeys(needed, 0)
                for x, t in around:
                    have[t] += 1
                    while all(have[k] >= n for k, (n, _) in needed.items()):
                        first = around[left][0]
                        if first <= at <= x and x - first < span and (best is None or x - first < best[1] - best[0]):
                            best = (first, x)
                        have[around[left][1]] -= 1
                        left += 1
                if best:
                    hits.add(best)
            if hits:
                yield w, sorted(hits)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def phrase_blocks(items: DataFrame, item: str, text: str, window: int, scratch: Scratch, block_bytes: int) -> str:
    """Write the windows of all items as a table of blocks (block); its path. The driver sees none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, text, block_bytes):
            block = Phrases.of(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), window)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    scratch(items.select(item, text).mapInArrow(run, "block binary"), "phrases")
    return scratch.paths["phrases"][-1]


_kept: dict[str, list[Phrases]] = {}
CACHES["phrases"] = _kept.clear


def read_blocks(path: str, held_bytes: int) -> Iterator[Phrases]:
    """The blocks of a table, one after the other; those of a small table stay in the worker's memory."""
    if path in _kept:
        yield from _kept[path]
        return
    where, root = store(path)
    files = sorted((f for f in where.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")), key=lambda f: f.path)
    blocks: list[Phrases] | None = [] if sum(f.size for f in files) <= held_bytes else None
    for f in files:
        with where.open_input_file(f.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(1, columns=["block"]):
                for x in batch.column(0):
                    block = pickle.loads(x.as_py())
                    if blocks is not None:
                        blocks.append(block)
                    yield block
    if blocks is not None:
        _kept.clear()
        _kept[path] = blocks


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", window: int = 10, span: int | None = None, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Rows (shard, ordinal, doc_id, text_key, n_words, matches) for every document of the index.

    matches: [start, end) in words of the document for each item, in runs that touch put together.
    Phrases are the windows of an item (an item of fewer words is one). span: take, in place of
    exact phrases, any range of at most so many words that has all words of a window. Items
    without words match nothing; a null item is an item like others, of any type."""
    if window >= GAP or (span or 0) >= GAP:
        raise ValueError(f"windows and spans have to be under {GAP} words")
    path = phrase_blocks(items, item, text, window, scratch or Scratch(index.sparkSession), block_bytes)
    kind, doc_kind = items.schema[item].dataType, index.schema["doc_ids"].dataType.elementType
    item_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        turn_to("phrases")
        held, size = [], 0
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            held.append(row)
            size += len(row["postings"]) + len(row["terms"])
            if size >= held_bytes:
                yield from matched(held)
                held, size = [], 0
        yield from matched(held)

    def matched(rows: list[dict]) -> Iterable[pa.RecordBatch]:
        shards = [Shard(row) for row in rows]
        found: list[dict[tuple, list[tuple[int, int]]]] = [{} for _ in shards]
        for p in read_blocks(path, held_bytes) if shards else ():
            for shard, mine in zip(shards, found):
                hits = ((w, [(s, s + p.length[w]) for s in starts]) for w, starts in shard.exact(p)) if span is None else ((w, [(a, b + 1) for a, b in x]) for w, x in shard.near(p, span))
                for w, spans in hits:
                    for a, b in spans:
                        doc = int(np.searchsorted(shard.base, a, side="right")) - 1
                        mine.setdefault((doc, p.item[w]), []).append((int(a - shard.base[doc]), int(b - shard.base[doc])))
        for row, shard, mine in zip(rows, shards, found):
            matches: list[list[dict]] = [[] for _ in shard.doc_ids]
            for (doc, item_id), spans in mine.items():
                matches[doc] += [{"item_id": item_id, "start": a, "end": b} for a, b in merged(spans)]
            list_type = pa.list_(pa.struct([("item_id", item_type), ("start", pa.int32()), ("end", pa.int32())]))
            n = len(matches)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(shard.doc_ids, doc_type), pa.array(row["text_keys"], pa.int64()), pa.array(np.diff(shard.first)), pa.array(matches, list_type)],
                ["shard", "ordinal", "doc_id", "text_key", "n_words", "matches"],
            )

    doc_type = to_arrow_type(doc_kind)
    return index.mapInArrow(run, f"shard string, ordinal int, doc_id {doc_kind.simpleString()}, text_key long, n_words long, matches array<struct<item_id:{kind.simpleString()},start:int,end:int>>")


def hit_words() -> Column:
    """Number of words within any match: the length of the union of the ranges."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    ranges_ = F.array_sort(F.transform("matches", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(ranges_, start, step, lambda s: s["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **limits: int) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, contaminated, matches, text_key), one for each row of docs.

    text_key: a hash of the text, which tells rows of one id apart. Null and empty texts have no words
    and no hits; without items nothing is contaminated. Other columns of docs are left out.
    limits: block_bytes and held_bytes of `search`."""
    found = search(build_index(docs, id, text, scratch), items, window=window, scratch=scratch, **limits)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["item_id"].cast("string"))))
    hit = hit_words()
    return found.select(
        F.col("doc_id").alias(id), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"), "matches", "text_key",
    )
