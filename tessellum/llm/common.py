"""Session helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path within it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def modest(spark: SparkSession) -> None:
    """Arrow batches of about 8 MB, in place of Spark's 64, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_BYTES, "67108864b") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(BATCH_BYTES, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessellum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessellum-{name}-{uuid.uuid4().hex}"


#: Frees the shuffle files of a query at its end; what it has written needs them no more.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_out(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder: the frame that reads it, and its path. Its shuffle files go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    return write_out(df, name)[0]


class Scratch:
    """The tables that an operator writes on its way; each goes as soon as its last reader is done.

    `drop` deletes tables by name, `close` all but the named ones. As a context, what isn't kept goes at
    the end, and everything goes when an error ends it."""

    def __init__(self, spark: SparkSession):
        modest(spark)
        self.spark, self.paths, self.kept = spark, {}, set()

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        frame, path = write_out(df, name)
        self.paths.setdefault(name, []).append(path)
        return frame

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that stays for whoever reads the operator's result."""
        self.kept.add(name)
        return self(df, name)

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        for name in names:
            for path in self.paths.pop(name, []):
                where = context._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def close(self, *keep: str) -> None:
        self.drop(*[name for name in self.paths if name not in keep])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(*(() if kind else self.kept))


#: How to empty the caches that operators keep in a Python worker, by operator; and whose turn it is.
CACHES: dict[str, Callable[[], None]] = {}
_turn = [""]


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Hand memory that is free but still held by the allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def turn_to(operator: str) -> None:
    """A worker that serves several operators keeps the caches of the present one alone."""
    if _turn[0] != operator:
        for name, clear in CACHES.items():
            if name != operator:
                clear()
        _turn[0] = operator
        gc.collect()
        give_back()


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column has about max_bytes at most (a longer text stands alone).

    Memory that a task has used goes back to the machine at its end, as idle workers stay."""
    turn_to(operator)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= max_bytes:
            yield batch
            continue
        lengths = col.cast(pa.large_binary()) if pa.types.is_large_string(col.type) else col.cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        start, used = 0, 0
        for i, size in enumerate(sizes):
            if i > start and used + size > max_bytes:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += int(size)
        yield batch.slice(start, n - start)
    give_back()
