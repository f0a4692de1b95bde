"""Exact search for the largest inner products, by buckets of vectors of like length.

Vectors are dealt out by length, longest first, and packed into blocks; a block
is a row of buckets.  A query's k-th best score so far, divided by its length
and the bucket's greatest, is the bucket's local cosine threshold: above 1 the
bucket is left out; near 1 only vectors whose coordinates lie where that cosine
allows, in the query's strongest coordinates, are multiplied out; below that,
those long enough.  What remains is verified with exact integer products.

A first pass over the bucket of longest vectors gives every query a threshold,
so that whole pairs of blocks can be left out before anything is sent.

Components are floor(``SCALE`` * x), scores integers.

Defined cases: vectors that are null or empty or hold null or non-finite
components, and rows without an id, take no part; vectors of different
dimension are never compared; rows equal in id and vector count once; a vector
isn't compared with those of its own id; ties go to the smaller id; with fewer
than ``k`` candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.texts import ship
from tablecare.sources.session import cut_lineage

SCALE = 256
#: Rows of a block of candidates, of one of its buckets, and of a block of queries.
BLOCK, BUCKET, QUERIES = 16384, 1024, 2048
#: Local cosine threshold from which coordinates are compared, and how many of them.
STEEP, STRONGEST = 0.8, 4

PACKED = "block long, dim int, n int, longest double, ids binary, lengths binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim, length and the components as 64-bit floats that hold whole numbers."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, dims, lengths = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                own = v.values
                if i is None or own is None or not len(own) or own.null_count:
                    continue
                x = own.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                ids.append(i)
                vectors.append(x.tobytes())
                dims.append(len(x))
                lengths.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(lengths, pa.float64()), pa.array(vectors, pa.binary())], ["vec_id", "dim", "length", "vector"]
            )

    picked = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec_id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, dim int, length double, vector binary").dropDuplicates(["vec_id", "vector"])


def _pack(size: int):
    """Rows of one dimension, in order of length, to packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []

        def block(part: pa.Table) -> pa.RecordBatch:
            data = [b"".join(part.column("vector").to_pylist()), part.column("vec_id").to_numpy().astype("<i8").tobytes(), part.column("length").to_numpy().astype("<f8").tobytes()]
            values = [task << 32 | made, part.column("dim")[0].as_py(), part.num_rows, max(part.column("length").to_pylist()), data[1], data[2], data[0]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            start = 0
            dims = batch.column("dim").to_numpy()
            while start < batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                same = start + int(np.argmax(dims[start:] != dims[start])) if (dims[start:] != dims[start]).any() else batch.num_rows
                if held and held[0].column("dim")[0].as_py() != dims[start]:
                    yield block(pa.Table.from_batches(held))
                    made, held = made + 1, []
                    continue
                stop = min(same, start + room)
                held.append(batch.slice(start, stop - start))
                start = stop
                if sum(b.num_rows for b in held) >= size:
                    yield block(pa.Table.from_batches(held))
                    made, held = made + 1, []
        if held:
            yield block(pa.Table.from_batches(held))

    return run


class Packed:
    def __init__(self, row: dict, prefix: str = ""):
        self.dim = row[f"{prefix}dim"]
        self.ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
        self.lengths = np.frombuffer(row[f"{prefix}lengths"], "<f8")
        self.vectors = np.frombuffer(row[f"{prefix}vectors"], "<f8").reshape(-1, self.dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    if any(abs(x) >= 2**63 for r in exact for x in r):
        raise OverflowError("a score doesn't fit in 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k best of each query so far, and the score that a further candidate must reach."""

    def __init__(self, queries: Packed, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least
        self.q, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        other = self.queries.ids[q] != ids
        q, ids, scores = (np.concatenate([a, b[other]]) for a, b in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort([ids, -scores, q])
        q, ids, scores = q[order], ids[order], scores[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])
        kept = nth < self.k
        self.q, self.ids, self.scores = q[kept], ids[kept], scores[kept]

    def scan(self, block: Packed, buckets: int | None = None) -> None:
        queries = self.queries
        for start in range(0, len(block.ids), BUCKET)[:buckets]:
            rows = slice(start, start + BUCKET)
            vectors, ids, lengths = block.vectors[rows], block.ids[rows], block.lengths[rows]
            reach = queries.lengths * lengths[0] * (1 + 1e-9) + 1e-6
            active = np.flatnonzero(reach >= self.least)
            local = self.least[active] / np.maximum(reach[active], 1e-300)
            steep = active[local >= STEEP]
            flat = active[local < STEEP]
            if len(flat):
                # long enough for one of the queries; lengths fall, so that is a prefix
                need = float(np.min(self.least[flat] / np.maximum(queries.lengths[flat], 1e-300)))
                stop = len(ids) if need <= 0 else int(np.searchsorted(-lengths, -need * (1 - 1e-9) + 1e-6, side="right"))
                scores = products(queries.vectors[flat], vectors[:stop])
                q, c = np.nonzero(scores >= self.least[flat][:, None])
                self.add(flat[q], ids[c], scores[q, c])
            for one in steep:
                fit = self._within(queries.vectors[one], queries.lengths[one], vectors, lengths, self.least[one])
                scores = products(queries.vectors[one : one + 1], vectors[fit])[0]
                good = scores >= self.least[one]
                self.add(np.full(int(good.sum()), one), ids[fit[good]], scores[good])

    @staticmethod
    def _within(query: np.ndarray, length: float, vectors: np.ndarray, lengths: np.ndarray, least: float) -> np.ndarray:
        """Rows whose unit vector can have a product of ``least`` with the query, by its strongest coordinates."""
        need = least / np.maximum(length * lengths, 1e-300)  # cosine that each row needs
        fit = np.flatnonzero(need <= 1 + 1e-9)
        for f in np.argsort(-np.abs(query))[:STRONGEST]:
            if not len(fit):
                break
            t, own = np.clip(need[fit], -1, 1), query[f] / length
            spread = np.sqrt((1 - t * t) * max(1 - own * own, 0)) + 1e-6
            # cosines of t or more: the interval holds the axis itself where the query is closer to it than t
            low, high = np.where(own < -t, -1, own * t) - spread, np.where(own > t, 1, own * t) + spread
            x = vectors[fit, f] / np.maximum(lengths[fit], 1e-300)
            fit = fit[(x >= low) & (x <= high)]
        return fit


def top_products(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best for each row that ``is_query`` (a condition on vec_id) picks."""
    spark = rows.sparkSession
    vectors = cut_lineage(whole_vectors(rows, id_col, vector_col, scale))
    ordered = vectors.repartitionByRange("dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")
    blocks = cut_lineage(ordered.mapInArrow(_pack(BLOCK), PACKED))
    queries = vectors.where(is_query).repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id").mapInArrow(_pack(QUERIES), PACKED)
    heads = blocks.groupBy("dim").agg(F.max_by("block", "longest").alias("block")).join(blocks, ["dim", "block"])
    start = heads.select("dim", *[F.col(c).alias(f"c_{c}") for c in ("n", "ids", "lengths", "vectors")], F.col("dim").alias("c_dim"))
    seeded = cut_lineage(queries.join(start, "dim").mapInArrow(_seed(k), f"{PACKED}, least binary, shortest double"))
    # a block whose longest vector is shorter than every query of a block asks for is left out
    reach = F.col("c_longest") * (1 + 1e-9) + 1e-6 >= F.col("shortest")
    targets = blocks.select("dim", F.col("block").alias("c_block"), F.col("longest").alias("c_longest"))
    sent = seeded.join(targets, "dim").where(reach).drop("c_longest")
    pairs = sent.join(blocks.select(F.col("block").alias("c_block"), *[F.col(c).alias(f"c_{c}") for c in ("dim", "ids", "lengths", "vectors")]), "c_block")
    found = pairs.select("dim", "ids", "lengths", "vectors", "least", "c_dim", "c_ids", "c_lengths", "c_vectors").mapInArrow(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _seed(k: int):
    """Query blocks with a threshold for each query, from the longest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            queries = Packed(row)
            best = Best(queries, k, np.full(len(queries.ids), -math.inf))
            best.scan(Packed(row, "c_"), 1)
            own = {c.split()[0]: row[c.split()[0]] for c in PACKED.split(", ")} | {"least": best.least.astype("<f8").tobytes(), "shortest": float(np.min(best.least / np.maximum(queries.lengths, 1e-300)))}
            yield pa.RecordBatch.from_pylist([own], pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("vectors", pa.binary()), ("least", pa.binary()), ("shortest", pa.float64())]))

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            queries = Packed(row)
            best = Best(queries, k, np.frombuffer(row["least"], "<f8").copy())
            best.scan(Packed(row, "c_"))
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[best.q]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

    return run
