"""A stored inverted file of vectors with product-quantised residuals.

Cells are the nearest of `nlist` unit centres. A vector's residual to its centre is cut into parts, each
named by the nearest of 256 codes, so a list holds a few bytes for each vector. A search reads the lists
of its `nprobe` nearest cells, adds up estimated cosines from a table of products for each part, and
takes the whole vectors of the `refine` best estimates of each query for exact cosines.

Lists lie in folders of cells, in segments of at most SEGMENT vectors, so a cell of any size is many rows;
whole vectors lie in the same folders. Centres and codes are fitted on a bounded sample (`sample` vectors
of the least hashes of their ids); every vector is indexed."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a segment, queries of a block, folders at most, parts of a cell that are written apart.
SEGMENT, BLOCK, FOLDERS, SALTS = 4096, 256, 1024, 8


def units(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors (of a dimension, finite, not zero), and those at length 1."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dimension = dimension or int(lengths.max(initial=0))
    fits = np.flatnonzero((lengths == dimension) & (lengths > 0))
    if not len(fits):
        return fits, np.empty((0, dimension or 1))
    x = pc.fill_null(pc.list_flatten(column.take(pa.array(fits))).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(fits), -1)
    norm = np.linalg.norm(x, axis=1)
    live = np.isfinite(norm) & (norm > 0)
    return fits[live], x[live] / norm[live, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    """Centres (nlist, d) and codes (parts, 256, d / parts): bounded by nlist, whatever the number of vectors."""

    centres: np.ndarray
    codes: np.ndarray

    @property
    def shift(self) -> int:
        """Cells of a folder, as a shift."""
        return max(0, int(np.ceil(np.log2(max(1, len(self.centres) / FOLDERS)))))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.codes), -1)
        return cell, np.stack([_nearest(rest[:, p], self.codes[p]) for p in range(len(self.codes))], axis=1).astype(np.uint8)


def train(vectors: DataFrame, nlist: int = 1024, parts: int = 16, sample: int = 50_000, rounds: int = 10, seed: int = 1) -> Model:
    """Centres and codes from at most `sample` vectors, those of the least hashes of their ids."""
    rows = vectors.select("vector", F.xxhash64("id").alias("h")).filter("size(vector) > 0").orderBy("h").limit(sample).select("vector").toArrow()
    column = rows.column(0).combine_chunks()
    _, x = units(column)
    if not len(x):
        raise ValueError("no vectors to fit an index on")
    parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0)
    centres = k_means(x, nlist, rounds, seed, spherical=True)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    codes = np.stack([np.resize(k_means(rest[:, p], 256, rounds, seed), (256, x.shape[1] // parts)) for p in range(parts)])
    return Model(centres, codes)


@dataclass
class VectorIndex:
    """A stored index: its folder, its model, and the type of ids."""

    spark: SparkSession
    path: str
    model: Model

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def insert(index: VectorIndex, vectors: DataFrame, name: str | None = None) -> None:
    """Append vectors (id, vector) to their cells; nothing that is stored is written again.

    name: of the addition; one that comes again under its name takes its own place.

    Vectors that are null, empty, all zero, not finite or of another length are in no cell."""
    model, kind = index.model, vectors.schema["id"].dataType
    shared = index.spark.sparkContext.broadcast(model)  # bounded by nlist

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            fits, x = units(batch.column(1), own.centres.shape[1])
            if len(fits):
                cell, codes = own.encoded(x)
                flat = pa.array(x.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell >> own.shift, pa.int32()), pa.array(cell, pa.int32()), batch.column(0).take(pa.array(fits)), raw, lists], ["folder", "cell", "id", "code", "vector"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kept: tuple[int, list, list] | None = None

        def row(cell: int, ids: list, codes: list) -> pa.RecordBatch:
            arrays = [pa.array([cell >> shift], pa.int32()), pa.array([cell], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([b"".join(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["folder", "cell", "ids", "codes"])

        for batch in batches:
            for cell, name, code in zip(*[batch.column(c).to_pylist() for c in ("cell", "id", "code")]):
                if kept and (kept[0] != cell or len(kept[1]) >= SEGMENT):
                    yield row(*kept)
                    kept = None
                kept = kept or (cell, [], [])
                kept[1].append(name), kept[2].append(code)
        if kept:
            yield row(*kept)

    id_type, shift = to_arrow_type(kind), model.shift
    part = f"part=p-{name or uuid.uuid4().hex}"
    rows = vectors.select("id", "vector").mapInArrow(assigned, f"folder int, cell int, id {kind.simpleString()}, code binary, vector array<float>")
    dealt = rows.repartition("folder", "cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("folder", "cell", "id")
    # codes and vectors are written by one job each; ids and vectors alone decide where rows go, so both are whole
    dealt.select("folder", "cell", "id", "code").mapInArrow(segments, f"folder int, cell int, ids array<{kind.simpleString()}>, codes binary").write.mode("overwrite").partitionBy("folder").parquet(f"{index.path}/lists/{part}")
    dealt.select("folder", "cell", "id", "vector").write.mode("overwrite").partitionBy("folder").parquet(f"{index.path}/vectors/{part}")


def build(vectors: DataFrame, path: str, nlist: int = 1024, parts: int = 16, sample: int = 50_000, seed: int = 1, name: str | None = None) -> VectorIndex:
    """Fit an index and write all vectors (id, vector) into it. name: as in `insert`."""
    spark = vectors.sparkSession
    model = train(vectors, nlist, parts, sample, seed=seed)
    index = VectorIndex(spark, path, model)
    rows = [("centre", 0, i, [float(v) for v in c]) for i, c in enumerate(model.centres)] + [("code", p, i, [float(v) for v in c]) for p, part in enumerate(model.codes) for i, c in enumerate(part)]
    spark.createDataFrame(rows, "kind string, part int, n int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    insert(index, vectors, name)
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "n").collect()  # bounded by nlist
    centres = np.array([r["vector"] for r in rows if r["kind"] == "centre"])
    codes = np.array([r["vector"] for r in rows if r["kind"] == "code"]).reshape(1 + max(r["part"] for r in rows if r["kind"] == "code"), 256, -1)
    return VectorIndex(spark, path, Model(centres, codes))


def candidates(index: VectorIndex, queries: DataFrame, nprobe: int, refine: int) -> DataFrame:
    """Rows (query_id, id, folder, cell): the `refine` best estimates of each query among its cells' lists."""
    model, key = index.model, queries.schema["query_id"].dataType
    shared = index.spark.sparkContext.broadcast(model)
    key_type, key_name, lists = to_arrow_type(key), key.simpleString(), index.lists()
    id_name = lists.schema["ids"].dataType.elementType.simpleString()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            fits, x = units(batch.column(1), own.centres.shape[1])
            if not len(fits):
                continue
            near = x @ own.centres.T
            n = min(nprobe, near.shape[1])
            cells = np.argpartition(-near, n - 1, axis=1)[:, :n]
            who = np.repeat(np.arange(len(fits)), n)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * x.shape[1], pa.int32()), pa.array(x[who].astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel() >> own.shift, pa.int32()), pa.array(cells.ravel(), pa.int32()), batch.column(0).take(pa.array(fits[who])), vectors], ["folder", "cell", "query_id", "query_vector"])

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.value
        parts, d = len(own.codes), own.centres.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                cell, ids, raw = batch.column("cell")[i].as_py(), batch.column("ids")[i].values, batch.column("codes")[i].as_py()
                names, asked = batch.column("query_ids")[i].values, batch.column("query_vectors")[i].values
                q = asked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), d)
                codes = np.frombuffer(raw, np.uint8).reshape(-1, parts)
                tables = np.einsum("qpd,pkd->qpk", q.reshape(len(q), parts, -1), own.codes)
                score = (q @ own.centres[cell])[:, None] + sum(tables[:, p, codes[:, p]] for p in range(parts))
                if score.shape[1] > refine:
                    best = np.argpartition(-score, refine - 1, axis=1)[:, :refine]
                else:
                    best = np.tile(np.arange(score.shape[1]), (len(q), 1))
                who = np.repeat(np.arange(len(q)), best.shape[1])
                arrays = [names.take(pa.array(who)), ids.take(pa.array(best.ravel())), pa.array(np.full(best.size, cell >> own.shift), pa.int32()), pa.array(np.full(best.size, cell), pa.int32()), pa.array(score[who, best.ravel()])]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "id", "folder", "cell", "estimate"])

    probes = queries.select("query_id", "query_vector").mapInArrow(probed, f"folder int, cell int, query_id {key_name}, query_vector array<float>")
    # queries of a cell in blocks, so that a task multiplies a matrix of them with a segment
    numbered = probes.withColumn("block", F.floor((F.row_number().over(W.partitionBy("folder", "cell", F.pmod(F.xxhash64("query_id"), F.lit(SALTS))).orderBy("query_id")) - 1) / BLOCK)).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
    pairs = F.sort_array(F.collect_list(F.struct("query_id", "query_vector")))
    asked = numbered.groupBy("folder", "cell", "salt", "block").agg(pairs.alias("q")).select("folder", "cell", F.col("q.query_id").alias("query_ids"), F.col("q.query_vector").alias("query_vectors"))
    met = lists.join(asked, ["folder", "cell"]).select("cell", "ids", "codes", "query_ids", "query_vectors")
    rows = met.mapInArrow(estimated, f"query_id {key_name}, id {id_name}, folder int, cell int, estimate double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("estimate"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= refine).select("query_id", "id", "folder", "cell")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, nprobe: int = 16, refine: int = 100) -> DataFrame:
    """Rows (query_id, id, score, rank): the k nearest vectors by cosine that the index finds; ties by id.

    queries: (query_id, query_vector); query ids are distinct. More cells (nprobe) and more whole vectors
    (refine, for each query) find more. Queries that are no vectors of the index's dimension find nothing."""
    shared = index.spark.sparkContext.broadcast(index.model.centres.shape[1])
    found = candidates(index, queries, nprobe, refine)
    whole = index.vectors().withColumnRenamed("vector", "__vector")
    both = found.join(whole, ["folder", "cell", "id"]).join(queries.select("query_id", "query_vector"), "query_id").select("query_id", "id", "__vector", "query_vector")
    kinds = both.schema["query_id"].dataType.simpleString(), both.schema["id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            (a, x), (b, y) = (units(batch.column(c), shared.value) for c in (2, 3))
            if len(a) and len(a) == len(b):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a)), batch.column(1).take(pa.array(a)), pa.array((x * y).sum(axis=1))], ["query_id", "id", "score"])

    rows = both.mapInArrow(scored, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
