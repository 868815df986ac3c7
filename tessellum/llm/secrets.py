"""Secrets in texts, told from widely copied examples by who has them.

A scan of each whole text finds spans of three base kinds and further candidates: long runs of key
characters. What a span holds is hashed; over all documents the hashes are counted by distinct
repositories and owners. A value that many owners have is an example that people copy; one of few owners,
made of enough different letters and digits, looks live. Candidates of that sort become spans of the
kind `owned`; base spans stay, and each span counts as live or as an example."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, sliced

KINDS = ("assign", "access", "hex", "owned")
#: The rules of the base kinds. In `access` and `hex` the length is part of the pattern: a run that is too short fails as a whole.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate: so many key characters, a letter and a digit among them, and so many different ones.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
DISTINCT = 10
#: A value of so many owners is an example.
OWNERS = 3
FOUND = "array<struct<start:int,kind:int,end:int,base:boolean,value:binary>>"


def looks_live(value: str) -> bool:
    return len(set(value)) >= DISTINCT and bool(DIGIT.search(value)) and bool(LETTER.search(value))


def spans(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, base, value) of base spans, and of candidates apart from them, by start, then kind."""
    base = [(m.start(), 0, m.end(), True, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), k, m.end(), True, m[0]) for k, rule in ((1, ACCESS), (2, HEX)) for m in rule.finditer(text)]
    runs = [(m.start(), 3, m.end(), False, m[0]) for m in RUN.finditer(text) if looks_live(m[0])]
    if base and runs:
        # a run that touches a base span is that span's: of the spans that begin before its end, one ends after its start
        starts = np.array(sorted(b[0] for b in base))
        reach = np.maximum.accumulate(np.array([b[2] for b in sorted(base, key=lambda b: b[0])]))
        before = np.searchsorted(starts, np.array([r[2] for r in runs]), "left")
        runs = [r for r, n in zip(runs, before) if n == 0 or reach[n - 1] <= r[0]]
    return sorted(base + runs)


def digest(found: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in found).encode()).hexdigest()


def scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, counts of base spans, their digest, and all spans and candidates found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.binary())]))
        for batch in sliced(batches, "__text"):
            rows = [spans(t or "") for t in batch.column("__text").to_pylist()]
            base = [[s for s in r if s[3]] for r in rows]
            counts = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in range(3)]
            found = [[{"start": a, "kind": k, "end": b, "base": is_base, "value": hashlib.md5(v.encode()).digest()} for a, k, b, is_base, v in r] for r in rows]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array([digest(r) for r in base], pa.string()), pa.array(found, kind)], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = f"{fields}, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def ownership(values: DataFrame) -> DataFrame:
    """For each value (value, repository, owner): in how many repositories of how many owners it stands; a repository
    belongs to an owner. Rows of the same three count once, and before any shuffle where they can."""
    by_owner = values.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def find(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text: str = "text", owners: int = OWNERS, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of docs: its id, n_assign, n_access, n_hex, base_sha256, spans (`kind:start:end`, comma-joined, by
    start, then kind), n_owned, n_live and n_example (spans by whether fewer than `owners` owners have their value).

    Null texts are empty; null repositories and owners are each one of their own; repeated rows stay, and count
    once for their repository; ids may repeat or be null; whole texts are scanned; other columns aren't read.
    An empty table gives no rows."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.coalesce(repository.cast("string"), F.lit("")).alias("__repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"))
    found = scratch(scanned(rows, "__text", ["__id", "__repository", "__owner"]).withColumn("row", F.monotonically_increasing_id()), "found")
    each = found.filter(F.size("found") > 0).select("row", "__repository", "__owner", F.explode("found").alias("s"))
    held = ownership(each.select("s.value", F.col("__repository").alias("repository"), F.col("__owner").alias("owner"))).select(F.col("value").alias("__value"), (F.col("n_owners") >= owners).alias("example"))
    told = each.select("row", "s.*").hint("merge").join(held.hint("merge"), F.col("value") == F.col("__value")).filter("base or not example")
    one = F.struct("start", "kind", "end", "example")
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("all"), F.count_if(F.col("kind") == 3).alias("n_owned"), F.count_if("example").alias("n_example"))
    shown = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    by_row = by_row.select(F.col("row").alias("__row"), shown.alias("spans"), "n_owned", (F.size("all") - F.col("n_example")).alias("n_live"), "n_example")
    out = found.join(by_row, F.col("row") == F.col("__row"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_live", "n_example")]
    return out.select(F.col("__id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *zero)
