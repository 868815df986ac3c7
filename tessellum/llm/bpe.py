"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list.

Texts are cut into pieces that never merge with each other (a run of non-space characters with the
one white space before it, or a run of white space), and the ids of a piece are kept in a cache of
bounded size in each Python worker. Null and empty texts give no ids. Added tokens in a text become
their own ids, wherever they stand; texts of any length are taken whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessellum.llm.common import CACHES, sliced

#: The Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public split pattern of byte-level vocabularies (fixed values).
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
COARSE = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space beyond ASCII, and what else keeps a text from being cut at single blanks and line feeds.
WIDE = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1f")
#: Bytes of the cache in each Python worker; an entry counts ENTRY bytes besides its piece and ids.
CACHE_BYTES, ENTRY = 160 << 20, 180
LONG_PIECE = 200


def pieces(text: str) -> list[str]:
    """Parts of a text whose ids don't depend on each other."""
    if any(x in text for x in RUNS) or not text.isascii() and WIDE.search(text):
        return COARSE.findall(text)
    parts = text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")
    return parts if parts[0] else parts[1:]


def byte_alphabet() -> dict[str, int]:
    """Visible character of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *added.values()])
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        by_bytes = {s: vocab[t] for t, s in ((t, self.strings[i]) for t, i in vocab.items()) if len(s) == 1}
        self.byte_ids = [by_bytes[bytes([b])] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[a] << 24 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.blob = np.frombuffer(b"".join(self.strings), np.uint8)
        self.lengths = np.fromiter(map(len, self.strings), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.cache = _Cache(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest rank, leftmost first, until no pair has a rank."""
        ids = [self.byte_ids[b] for b in piece]
        n, ranks, made = len(ids), self.ranks, self.made
        queue = []
        for i in range(n - 1):
            rank = ranks.get(ids[i] << 24 | ids[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heapq.heappop(queue)
            i, new = top & 0xFFFFFFFF, made[top >> 32]
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue  # merged away, or the last symbol now
            now = ranks.get(ids[i] << 24 | ids[j])
            if now is None or made[now] != new:
                continue  # a neighbour has changed since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(new << 24 | ids[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(ids[h] << 24 | new)
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        if len(piece) > 2 and piece[-1] in ".," and piece[-2].isalnum():  # such a mark is a token of its own
            return self.cache[piece[:-1]] + self.cache[piece[-1]]
        out: list[int] = []
        for token in SPLIT.findall(piece):
            out += self.merge(token.encode())
        return np.array(out, self.width).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.width)
        get = self.cache.__getitem__
        if not any(t in text for t in self.added):
            return np.frombuffer(b"".join(map(get, pieces(text))), self.width)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [b"".join(map(get, pieces(text[at : m.start()]))), np.array([self.added[m[0]]], self.width).tobytes()]
            at = m.end()
        parts.append(b"".join(map(get, pieces(text[at:]))))
        return np.frombuffer(b"".join(parts), self.width)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The vocabulary strings of ids, one after the other."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Cache(dict):
    """Piece -> packed ids; emptied when it has CACHE_BYTES; long pieces are not kept."""

    def __init__(self, codec: Codec):
        self.codec, self.room = codec, CACHE_BYTES

    def __missing__(self, piece: str) -> bytes:
        value = self.codec.packed(piece) if piece else b""
        if len(piece) <= LONG_PIECE:
            self.room -= len(piece) + len(value) + ENTRY
            if self.room < 0:
                self.clear()
                self.room = CACHE_BYTES
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each vocabulary in each Python worker."""
    return Codec(path)


CACHES["bpe"] = codec.cache_clear


def bpe_encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """Rows (id, ids): token ids of every whole text. Null or empty text: an empty list. Rows that repeat stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches, text, operator="bpe"):
            rows = [c.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id, ids])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, `{ids}` array<int>")


def bpe_decode(df: DataFrame, path: str, id: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows (id, text): the text of each list of ids. Null ids: null; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id, text])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, ids).mapInArrow(run, f"`{id}` {kind}, `{text}` string")


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal digits with a comma after it, as a matrix of bytes, and the lengths."""
    texts = np.array([f"{i}," for i in range(size)], dtype=bytes)
    return texts.view(np.uint8).reshape(size, -1), np.char.str_len(texts)


def round_trip_digests(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): every text encoded, then decoded from its ids; keep_ids adds the ids.

    Null or empty text: no tokens, both digests of the empty string. Rows that repeat stay, other columns
    are left out, whatever their names; an empty table gives no rows."""
    from hashlib import sha256

    names = [id, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        c = codec(path)
        digits, lengths = decimal_table(len(c.strings))
        column = np.arange(digits.shape[1])
        for batch in sliced(batches, text, operator="bpe"):
            all_ids, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t)
                all_ids.append(ids)
                decimal = digits[ids][column < lengths[ids][:, None]].tobytes()[:-1]
                of_ids.append(sha256(decimal).hexdigest())
                of_text.append(sha256(c.decode(ids).encode()).hexdigest())
            n = np.array([len(x) for x in all_ids], np.int64)
            columns = [batch.column(0), pa.array(n), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if keep_ids:
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
