"""Near duplicates among shingle sets: SuperMinHash signatures, bands, exact verification, components.

1. A document's set is that of its distinct shingles of WORDS words. Documents of equal sets form one
   node at once, however many they are; all further work is on nodes.
2. A node's signature has SLOTS values. Each element ranks the slots by a random permutation of its
   own, drawn step by step; an element at step j offers j plus a fraction to the slot at that rank, so
   no slot takes two first ranks of one element. A document stops when no later step can improve a slot.
3. ROWS values make a band; nodes that agree in a band share a bucket. Two sets of similarity 0.75 share
   none of the BANDS buckets with a probability of 6e-6, of similarity 0.8 with 5e-8.
4. Each node is compared with the most central node of each of its buckets, the one with the most
   company in all its buckets, so that copies meet what they are copies of. After components have
   formed, the nodes of buckets that still hold several of them are compared across components, by a
   prefix filter, which is exact: with all their shingles in one order, the rarest first, two sets that
   are similar enough have their first common shingle within the first quarter of both, and so early
   that enough others can follow. Only nodes that share such a shingle become pairs, and for each
   shingle the largest component is compared with the rest, never with itself. All pairs are verified.
   So no bucket is capped, and pairs within a component, however large, are never listed.
5. Verification takes the whole texts of both sides and counts their common shingles.

Words are those of [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, sliced, turn_to
from tessellum.llm.components import connected
from tessellum.llm.textvec import SPACE, Texts, U, mix, owner, prefix, ranges, spans_hashed

WORDS, SLOTS, ROWS = 5, 128, 4
BANDS = SLOTS // ROWS
SIMILARITY = 75
#: Two bits of each slot are kept to compare a node with its leaders: at a similarity of 0.75, 32 of 256 bits differ on average
#: (standard deviation 6.3), so more than these with less than 1e-10. Such a pair isn't lost: its bucket stays unsettled.
MOST_BITS = 80
CHUNK = 1 << 16
STEP = 0x9E3779B97F4A7C15


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: their hashes and their texts' numbers, in order of the texts; the number of texts."""
    texts = Texts(column, fold=True)
    start, end, first = texts.words(~SPACE)
    hashes = spans_hashed(texts.buf, start, end)
    n = np.diff(first)
    of = owner(first)
    begin = np.flatnonzero(np.arange(len(start)) + WORDS <= first[1:][of])
    brief = np.flatnonzero((n > 0) & (n < WORDS))
    begin, stop, of = np.concatenate((begin, first[brief])), np.concatenate((begin + WORDS, first[brief] + n[brief])), np.concatenate((of[begin], brief))
    keys = ranges(prefix(hashes), begin, stop)
    order = np.argsort(keys ^ mix(of.astype(U) + U(1)))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    order = np.argsort(of.astype(np.uint16) if texts.n < 1 << 16 else of, kind="stable")
    return keys[order], of[order], texts.n


def superminhash(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, SLOTS) of the sets 0 to n - 1; values are step << 32 | fraction."""
    out = np.full(n * SLOTS, np.iinfo(np.uint64).max, U)
    rank = np.empty((len(keys), SLOTS), np.uint8)
    rank[:] = np.arange(SLOTS, dtype=np.uint8)
    active = np.arange(len(keys))
    for j in range(SLOTS):
        key, mine = keys[active], of[active]
        draw = mix(key + U((j + 1) * STEP & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw >> U(32)) * U(SLOTS - j) >> U(32)).astype(np.int64)
        slot = rank[active, k]
        rank[active, k] = rank[active, j]
        np.minimum.at(out, mine * SLOTS + slot, U(j) << U(32) | (draw & U(0xFFFFFFFF)))
        open_ = out.reshape(n, SLOTS).max(axis=1) >= U(j + 1) << U(32)
        active = active[open_[mine]]
        if not len(active):
            break
    return out.reshape(n, SLOTS)


def signatures(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """superminhash over so many texts at a time that the ranks need little memory."""
    first = np.searchsorted(of, np.arange(n + 1))
    parts, a = [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(first, first[a] + CHUNK, side="right")) - 1)
        parts.append(superminhash(keys[first[a] : first[b]], of[first[a] : first[b]] - a, b - a))
        a = b
    return np.concatenate(parts) if parts else np.zeros((0, SLOTS), U)


def described(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, node, bits, bands); node, bits and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, text):
            keys, of, n = shingles(batch.column(1))
            size = np.bincount(of, minlength=n)
            total = np.zeros(n, U)
            np.add.at(total, of, mix(keys ^ U(0x5851F42D4C957F2D)))
            node = mix(total + size.astype(U) * U(STEP)).view(np.int64)
            values = signatures(keys, of, n)
            band = mix(np.arange(BANDS, dtype=U) + U(77))
            for r in range(ROWS):
                band = mix(band ^ values.reshape(n, BANDS, ROWS)[:, :, r])
            two = (mix(values) & U(3)).astype(np.uint8)
            bits = np.packbits(np.stack((two & 1, two >> 1), axis=2).reshape(n, 2 * SLOTS), axis=1).view(np.int64)
            null = size == 0
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(null, 0, x.shape[1])))), pa.int32()), pa.array(x[~null].ravel().view(np.int64)), mask=pa.array(null)) for x in (bits, band.reshape(n, BANDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), pa.array(node, mask=null), *lists], ["doc_id", "text_key", "n_shingles", "node", "bits", "bands"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text), F.xxhash64(text)).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, node long, bits array<long>, bands array<long>")


def differing(x: Column, y: Column) -> Column:
    """How many of the kept signature bits differ."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, 4)), F.bit_count(x[0].bitwiseXOR(y[0])))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        turn_to("")
        for batch in batches:
            at, bytes_ = 0, 0
            sizes = [len(x or "") + len(y or "") for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            for i, s in enumerate([*sizes, 0]):
                bytes_ += s
                if i > at and (bytes_ > 1 << 21 or i == len(sizes)):
                    part = batch.slice(at, i - at)
                    keep = compare(part.column(2), part.column(3))
                    yield part.select([0, 1]).filter(pa.array(keep))
                    at, bytes_ = i, s

    def compare(left: pa.Array, right: pa.Array) -> np.ndarray:
        (x, of_x, n), (y, of_y, _) = shingles(left), shingles(right)
        size = np.bincount(of_x, minlength=n) + np.bincount(of_y, minlength=n)
        key, of = np.concatenate((x, y)), np.concatenate((of_x, of_y))
        order = np.argsort(key ^ mix(of.astype(U) + U(1)))
        key, of = key[order], of[order]
        common = np.bincount(of[1:][(key[1:] == key[:-1]) & (of[1:] == of[:-1])], minlength=n)
        return (100 * common >= SIMILARITY * (size - common)) & (common > 0)

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept, text_key), one for each row of docs.

    component_id: the least id that can be reached over links, the row's own included; kept: whether
    that is the row's own; text_key: a hash of the text, which tells rows of one id apart. A document
    without words is linked with nothing. Rows that repeat are copies of each other (so of two rows with
    one id and one text, both are kept or none). A null id is never a component's least id unless all ids
    in it are null. Other columns are left out; an empty table gives no rows. scratch: takes the two
    tables that the result reads; without it they stay."""
    own = Scratch(docs.sparkSession) if scratch is None else scratch
    described_ = own(described(docs, id, text), "signatures")
    nodes = own(described_.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = own(members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("company")).filter("lo <> hi").select("bucket", "company"), "buckets")
    crowded = own(members.join(shared, "bucket"), "members")
    own.drop("buckets")
    central = crowded.groupBy("node").agg(F.sum("company").alias("company"))
    leaders = own(crowded.select("bucket", "node").join(central, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("most")).select("bucket", F.col("most.node").alias("leader")), "leaders")
    stars = crowded.join(leaders, "bucket").filter("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    side = lambda name, bits: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(bits))
    alike = (100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (differing(F.col("x"), F.col("y")) <= MOST_BITS)
    stars = own(stars.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(alike).select("a", "b"), "stars")
    own.drop("leaders")

    wanted = crowded.select("node").distinct().join(nodes.select("node", "least_id"), "node")
    found = docs.select(F.col(id).alias("__id"), F.col(text).alias("text")).join(wanted, F.col("__id").eqNullSafe(F.col("least_id"))).select("node", "text")
    texts = own(of_node(found), "texts")

    links = own(similar(stars, texts), "links")
    roots = connected(links, own)
    placed = crowded.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    loose = own(placed.join(mixed, "bucket").select("node", "root").distinct().join(nodes.select("node", "n"), "node"), "loose")
    own.drop("members")
    across = own(candidates(loose, texts, own).join(stars, ["a", "b"], "left_anti"), "across")
    more = own(similar(across, texts), "more-links")
    own.drop("texts", "loose", "heads", "across", "stars")
    if not more.isEmpty():
        roots = connected(links.union(more), own, "roots-again")

    rooted = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = own(rooted.join(least, "root").select("node", "component_id"), "classes")
    own.close("signatures", "classes") if scratch is None else own.drop("nodes", "links", "more-links", "roots", "roots-again", "least")
    out = described_.select("doc_id", "text_key", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def candidates(loose: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root, n) with different roots that the prefix filter lets through, once each.

    A shingle that no other of these nodes has comes first in its node's order and makes no pairs, so it is only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            keys, of, _ = shingles(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(of))], ["shingle", "node"])

    rows = texts.join(loose.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "shingle long, node long")
    times = rows.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    mine = W.partitionBy("node")
    ranked = rows.join(times, "shingle").join(loose, "node").select("shingle", "node", "root", "n", F.row_number().over(mine.orderBy("times", "shingle")).alias("rank"), F.count("*").over(mine).alias("common"))
    place = F.col("n") - F.col("common") + F.col("rank")
    quarter = F.col("n") - F.floor((SIMILARITY * F.col("n") + 99) / 100) + 1
    heads = scratch(ranked.select("shingle", "node", "root", "n", place.alias("place")).filter(F.col("place") <= quarter), "heads")
    by_root = heads.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    lists = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1").select("shingle", "largest")
    x, y = (heads.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("root", "n", "place")], F.col("node").alias(end)) for end in "ab")
    x = x.join(lists, "shingle").filter("root_a <> largest").drop("largest").withColumnRenamed("shingle", "__shingle")
    follow = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = (100 + SIMILARITY) * follow >= SIMILARITY * (F.col("n_a") + F.col("n_b"))
    sized = 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    pairs = x.join(y, (F.col("__shingle") == F.col("shingle")) & (F.col("root_a") != F.col("root_b")) & sized & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def of_node(found: DataFrame) -> DataFrame:
    """Of rows (node, text), one whose text has the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            keys, of, n = shingles(batch.column(1))
            total = np.zeros(n, U)
            np.add.at(total, of, mix(keys ^ U(0x5851F42D4C957F2D)))
            node = mix(total + np.bincount(of, minlength=n).astype(U) * U(STEP)).view(np.int64)
            yield batch.filter(pa.array(node == batch.column(0).to_numpy()))

    return found.mapInArrow(run, "node long, text string").dropDuplicates(["node"])
