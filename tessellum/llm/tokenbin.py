"""Token ids in flat unsigned integer files with 64-bit document offsets.

Format, for each part k in ascending order of document id: part-k.bin holds the ids (16 or 32 bits,
little-endian, whichever the vocabulary needs), part-k.off the 64-bit start of each document within
the part and the part's length at the end, part-k.doc the 64-bit document ids (NO_ID: null).
manifest.json has the width and each part's base: the sum of the lengths of all parts before it.
A part is written under a name of its attempt and renamed at its end, so a task that runs again,
or twice at once, leaves one whole file. Readers map the files into memory where they are local.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessellum.llm.bpe import COARSE, LONG_PIECE, RUNS, WIDE
from tessellum.llm.common import CACHES, sliced, store

#: Stands for a document id that is null; such documents come first.
NO_ID = -(2**63)
FIRST = "\x1f"
#: Bytes of pieces and ids that a worker remembers; an entry counts ENTRY bytes besides its piece and ids.
CACHE_BYTES, ENTRY = 260 << 20, 180


class Encoder:
    """The tokenizers library, asked once for each piece of text in the cache's memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: Bytes of text that each id stands for: one for each character of a byte-level token.
        self.lengths = np.array([len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i)) for i in range(size)])
        self.cache: dict[str, bytes] = {"": b""}
        self.room = CACHE_BYTES

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def packed(self, parts: list[str]) -> list[bytes]:
        """Packed ids of pieces without added tokens; many go to the library as the words of one sequence."""
        out: list[bytes] = []
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, self.width)
            ends = np.cumsum([len(p.encode()) for p in some])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            data, at = ids.tobytes(), (cuts * self.width.itemsize).tolist()
            out += [data[x:y] for x, y in zip([0, *at], at)]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a text with an added token in it goes to the library whole.

        Between words with single white space, a key is a word whose blank goes without saying, or a
        line feed and the word after it; the text's first word and other texts' pieces come after FIRST."""
        cut = [None if t and any(x in t for x in self.added) else keys(t) if t else [] for t in texts]
        new = set().union(*(x for x in cut if x)).difference(self.cache)
        if self.room < 0:
            self.cache, self.room = {"": b""}, CACHE_BYTES
            new = set().union(*(x for x in cut if x)).difference(self.cache)
        ended = [p for p in new if len(p) > 2 and p[-1] in ".," and p[-2].isalnum()]
        fresh = list((new.difference(ended) | {p[:-1] for p in ended} | {f"{FIRST}.", f"{FIRST},"}).difference(self.cache))
        self.cache.update(zip(fresh, self.packed([p[1:] if p[0] == FIRST else p if p[0] == "\n" else f" {p}" for p in fresh]), strict=True))
        self.cache.update((p, self.cache[p[:-1]] + self.cache[FIRST + p[-1]]) for p in ended)  # a mark after a letter or digit is a token of its own
        get = self.cache.__getitem__
        out = [self.whole(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, cut, strict=True)]
        for piece in [p for p in (*fresh, *ended) if len(p) > LONG_PIECE]:
            del self.cache[piece]
        self.room -= sum(len(p) + len(self.cache[p]) + ENTRY for p in (*fresh, *ended) if p in self.cache)
        return out


def keys(text: str) -> list[str]:
    if any(x in text for x in RUNS) or not text.isascii() and WIDE.search(text):
        return [FIRST + p for p in COARSE.findall(text)]
    parts = text.replace("\n", " \n").split(" ")
    if parts[0] and parts[0][0] != "\n":
        parts[0] = FIRST + parts[0]
    if parts[-1] == "":  # the text ends with a blank
        parts[-1] = f"{FIRST} "
    return parts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CACHES["tokenbin"] = encoder.cache_clear


def ranged(df: DataFrame, id: str, text: str, parts: int) -> DataFrame:
    """df (id, text) dealt into parts of ascending ids, in order within each; null ids come first.

    The limits come from the ids alone, so texts are read once. An id that is the limit of several parts,
    as one with many rows is, has its rows dealt among these by ranges of a hash of their texts, so no task
    gets all of them; rows of one id stand in the order of that hash, then of their texts."""
    key, hashed = F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    rows = df.select(id, text)
    shares = [i / parts for i in range(1, parts)]
    limits = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("x")).first()["x"] if shares else None
    if not limits:
        return rows.repartitionById(1, F.lit(0)).sortWithinPartitions(key, hashed, text)
    ends = sorted(set(limits))
    table, first, times = (F.array(*[F.lit(int(x)).cast("long") for x in xs]) for xs in (ends, [*map(limits.index, ends), len(limits)], [*map(limits.count, ends), 1]))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s, _):  # the first limit that is not below the id
        over = F.try_element_at(table, middle(s) + 1) >= key
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | over, s["lo"]).otherwise(middle(s) + 1).alias("lo"), F.when(~done & over, middle(s)).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi")), halve, lambda s: s["lo"])
    share = (F.shiftrightunsigned(hashed, 33) + (1 << 30)) % (1 << 31) / (1 << 31)  # ascends with the hash
    within = F.when(F.try_element_at(table, found + 1) == key, F.floor(share * F.element_at(times, found + 1))).otherwise(F.lit(0))
    return rows.repartitionById(parts, (F.element_at(first, found + 1) + within).cast("int")).sortWithinPartitions(key, hashed, text)


def write_tokens(df: DataFrame, out: str, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text", parts: int | None = None) -> dict:
    """Encode every whole text (null: empty) and an end id after each into files under `out`; the manifest.

    Equal document ids stand next to each other, in order of a hash of their texts. Only the parts' lengths
    come to the driver. An empty table gives a manifest without parts. Ids have to be integers of any
    size up to 64 bits (a null one is kept as NO_ID); others are refused. Other columns are left out."""
    if not isinstance(df.schema[id].dataType, IntegralType):
        raise ValueError(f"the files have 64-bit integer ids; {id} is {df.schema[id].dataType.simpleString()}")
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    filesystem, base = store(out)
    filesystem.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, root = store(out)
        enc, attempt = None, uuid.uuid4().hex
        names = {kind: (f"{root}/.{attempt}-{part:05d}.{kind}", f"{root}/part-{part:05d}.{kind}") for kind in ("bin", "off", "doc")}
        starts, at = [np.zeros(1, np.uint64)], 0
        docs: list[np.ndarray] = []
        files = None
        for batch in sliced(batches, text, operator="tokenbin"):
            if files is None:
                enc = encoder(tokenizer)
                files = where.open_output_stream(names["bin"][0])
                end = np.array([end_id], enc.width).tobytes()
            rows = enc.encode_batch(batch.column(1).to_pylist())
            files.write(b"".join(x for r in rows for x in (r, end)))
            lengths = np.array([len(r) + len(end) for r in rows], np.uint64) // np.uint64(enc.width.itemsize)
            starts.append(np.uint64(at) + np.cumsum(lengths, dtype=np.uint64))
            at = int(starts[-1][-1])
            docs.append(batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy())
        if files is None:
            return
        files.close()
        for kind, content in (("off", np.concatenate(starts).astype("<u8")), ("doc", np.concatenate(docs).astype("<i8"))):
            with where.open_output_stream(names[kind][0]) as f:
                f.write(content.tobytes())
        for temporary, final in names.values():
            where.move(temporary, final)
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": sum(map(len, docs)), "n_ids": at, "width": enc.width.itemsize}], schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    written = sorted(ranged(df.select(id, text), id, text, parts).mapInArrow(run, "part int, n_docs long, n_ids long, width int").collect())
    manifest: dict = {"width": written[0]["width"] if written else 2, "parts": []}
    total = 0
    for row in written:
        manifest["parts"].append({"part": row["part"], "n_docs": row["n_docs"], "n_ids": row["n_ids"], "base": total})
        total += row["n_ids"]
    manifest["n_ids"] = total
    with filesystem.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(where: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(where, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype)


def read_tokens(spark: SparkSession, out: str, digests: bool = False) -> DataFrame:
    """Documents of the files under `out`: (doc_id, start, n_tokens, ids), or ids_crc32 in place of ids.

    ids_crc32 is taken over the ids as little-endian 32-bit integers, whatever the file's width."""
    filesystem, base = store(out)
    with filesystem.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = f"<u{manifest['width']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        where, root = store(out)
        for row in (r for b in batches for r in b.to_pylist()):
            ids, off, doc = (mapped(where, f"{root}/part-{row['part']:05d}.{kind}", t) for kind, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
            for a in range(0, len(doc), 256):
                mine = doc[a : a + 256]
                bounds = off[a : a + len(mine) + 1].astype(np.int64)
                values = [ids[x:y].astype("<u4") for x, y in zip(bounds, bounds[1:])]
                last = pa.array([zlib.crc32(v.tobytes()) for v in values], pa.int64()) if digests else pa.array(values, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(mine, mask=mine == NO_ID), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    rows = [(p["part"], p["base"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part int, base long").repartition(max(1, len(rows)))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))
