"""Nearest neighbours by counted collisions of single projections.

Every distinct vector is projected on ``PROJECTIONS`` random directions.  The
index is a table of blocks: a block holds its vectors and, for each direction,
its projected values in order with the places they belong to.  A query opens a
window of half-width ``WIDTH`` * radius around its own value in each of these
sorted arrays; a vector inside a window collides.  Vectors that collide in
``THRESHOLD`` directions or more are verified by their distance.

The radius grows (virtual rehashing): wider windows are the same arrays read a
little further to both sides, so counts only go up.  A query is done with a
block once its radius has reached its k-th smallest distance so far: of the
vectors within the radius a share of at least ``p`` (``found_share``) has been
verified, whatever the data look like.

A first block for each query block gives distances with which the others begin,
so there a query opens no wider than it must.

Defined cases: vectors that are null, empty or zero or hold null, non-finite or
over 1e150 sized components, and rows without an id, take no part; vectors of
different dimension are never compared; rows equal in id and vector are one
row; a query's candidates are all rows but its own; rows of one id with
different vectors are different rows, each a query of its own and a candidate
of the others; ties go to the smaller id; with fewer than ``k`` candidates all
are returned; an empty table gives no rows.
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
from tablecare.llm.vectors import finite, packed, unpacked
from tablecare.sources.session import cut_lineage

#: Directions, half-width of a window at radius 1, collisions asked for.
PROJECTIONS, WIDTH, THRESHOLD = 96, 1.3, 70
#: The radius grows by this factor, from this share of the distance known at the start.
GROWTH, START = 1.25, 0.8
#: Vectors of an index block, and of a query block.
BLOCK, QUERIES = 8192, 256
#: Parts in which block numbers are paired.
SLOTS = 64
LARGEST = 1e150

VECTORS = "vec_id long, dim int, lead double, vector binary"
INDEX = "block long, dim int, kind string, scale double, ids binary, id_ends binary, vectors binary, values binary, places binary"
QUERY = "block long, dim int, kind string, numbers binary, vectors binary"
FOUND = "number long, vec_id long, score double"


def found_share(projections: int = PROJECTIONS, width: float = WIDTH, threshold: int = THRESHOLD) -> float:
    """The least probability that a vector within the radius is verified."""
    p = math.erf(width / math.sqrt(2))
    return sum(math.comb(projections, c) * p**c * (1 - p) ** (projections - c) for c in range(threshold, projections + 1))


def directions(dim: int) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng(dim).standard_normal((PROJECTIONS, dim))


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, the first projected value and the vector as bytes, of single precision where the column is."""
    ship(rows.sparkSession)
    kind = kind_of(rows, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column("vec_id"), batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            for at, x in finite(batch.column("v")):
                size = np.abs(x).max(axis=1)
                good = np.flatnonzero((size > 0) & (size <= LARGEST) & known[at])
                x = x[good] + 0.0  # one zero only
                lead = x @ directions(x.shape[1])[0]
                dims = np.full(len(good), x.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[good])), pa.array(dims), pa.array(lead), packed(x.astype(kind)).cast(pa.binary())], ["vec_id", "dim", "lead", "vector"])

    picked = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec_id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    return picked.mapInArrow(run, VECTORS)


def kind_of(rows: DataFrame, vector_col: str = "embedding") -> str:
    """Bytes of a component."""
    return "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"


def _one(kinds: str, *values) -> pa.RecordBatch:
    names = [c.split() for c in kinds.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, names, strict=True)], [n for n, _ in names])


def _blocks(size: int, make, kind: str):
    """Rows of one dimension after the other to blocks of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows:
                dims = held.column("dim").to_numpy()
                run_ends = np.flatnonzero(dims != dims[0])
                same = int(run_ends[0]) if len(run_ends) else len(dims)
                if same < size and same == len(dims):
                    break
                take = min(same, size)
                yield make(task << 32 | made, int(dims[0]), held.slice(0, take), kind)
                made, held = made + 1, held.slice(take)
        if held is not None and held.num_rows:
            yield make(task << 32 | made, held.column("dim")[0].as_py(), held, kind)

    return run


def _matrix(part: pa.Table, dim: int, kind: str) -> np.ndarray:
    return unpacked(part.column("vector").combine_chunks(), np.arange(part.num_rows), kind, dim)


def _index_block(number: int, dim: int, part: pa.Table, kind: str) -> pa.RecordBatch:
    x = _matrix(part, dim, kind).astype(np.float64)
    values = (x @ directions(dim).T).T
    scale = float(np.abs(values).max())  # so that single precision holds them
    values /= scale
    order = np.argsort(values, axis=1, kind="stable")
    lists = part.column("ids").combine_chunks()
    ends = np.cumsum([len(v) for v in lists.to_pylist()])
    data = (lists.flatten().to_numpy().astype("<i8"), ends.astype("<i8"), x.astype(kind), np.take_along_axis(values, order, axis=1).astype("<f4"), order.astype("<u2"))
    return _one(INDEX, number, dim, kind, scale, *(d.tobytes() for d in data))


def _query_block(number: int, dim: int, part: pa.Table, kind: str) -> pa.RecordBatch:
    return _one(QUERY, number, dim, kind, part.column("number").to_numpy().astype("<i8").tobytes(), _matrix(part, dim, kind).tobytes())


class Block:
    """An index block as arrays."""

    def __init__(self, row: dict):
        dim, self.scale = row["dim"], row["scale"]
        self.ids, ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_ends"], "<i8")
        self.first = np.concatenate([[0], ends])
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim)
        self.values = np.frombuffer(row["values"], "<f4").reshape(PROJECTIONS, -1)
        self.places = np.frombuffer(row["places"], "<u2").reshape(PROJECTIONS, -1)

    def search(self, queries: np.ndarray, at: np.ndarray, k: int, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and distances of the k nearest rows found that may be within its bound."""
        n, at = len(self.vectors), (at / self.scale).T
        counts, verified = np.zeros((len(queries), n), np.int16), np.zeros((len(queries), n), bool)
        low = self._places(at, "left")
        high = low.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        radius = np.where(np.isfinite(bounds), START * bounds, self._first_radius(at, k))
        limits, active = bounds.copy(), np.arange(len(queries))
        while len(active):
            values = at[:, active]
            reach = WIDTH * radius[active] / self.scale * (1 + 1e-5) + 1e-6 * np.abs(values)  # the arrays hold single precision
            left = np.minimum(self._places(values - reach, "left"), low[:, active])
            right = np.maximum(self._places(values + reach, "right"), high[:, active])
            for i, q in enumerate(active):
                edges = zip(self.places, left[:, i], low[:, q], high[:, q], right[:, i], strict=True)
                new = [p for row, a, b, c, d in edges for p in (row[a:b], row[c:d])]
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            low[:, active], high[:, active] = left, right
            whole = ((left == 0) & (right == n)).all(axis=0)
            for q, every in zip(active, whole, strict=True):
                fresh = np.flatnonzero(~verified[q] & ((counts[q] >= THRESHOLD) | every))
                if len(fresh):
                    verified[q, fresh] = True
                    best[q] = self._nearer(queries[q], fresh, best[q], k)
                    if len(best[q][0]) == k:
                        limits[q] = min(limits[q], best[q][1][-1])
            active = active[~whole & (radius[active] < limits[active])]
            radius[active] = np.minimum(radius[active] * GROWTH, limits[active])
        return best

    def _places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where each direction's sorted array would take its values."""
        return np.stack([np.searchsorted(v, x.astype(np.float32), side=side) for v, x in zip(self.values, values, strict=True)])

    def _nearer(self, query: np.ndarray, fresh: np.ndarray, best: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those so far and of the rows of some more vectors."""
        distance = np.sqrt(((self.vectors[fresh].astype(np.float64) - query) ** 2).sum(axis=1))
        sizes = self.first[fresh + 1] - self.first[fresh]
        rows = np.repeat(self.first[fresh] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids, scores = np.concatenate([best[0], self.ids[rows]]), np.concatenate([best[1], np.repeat(distance, sizes)])
        order = np.lexsort([ids, scores])[:k]
        return ids[order], scores[order]

    def _first_radius(self, at: np.ndarray, k: int) -> np.ndarray:
        """For each query the distance in which the middle direction has k values to either side, above zero."""
        n, gaps = len(self.vectors), []
        for v, a, i in zip(self.values, at, self._places(at, "left"), strict=True):
            gaps.append(np.maximum(np.abs(v[np.minimum(i + k, n - 1)] - a), np.abs(a - v[np.maximum(i - k, 0)])))
        return np.maximum(np.median(gaps, axis=0), 1e-6) * self.scale

    def bounds(self, queries: np.ndarray, k: int) -> np.ndarray:
        """No less than the k-th smallest distance of each query's candidates; infinite where the block has fewer."""
        if len(self.vectors) < k:
            return np.full(len(queries), math.inf)
        unit = max(float(np.abs(self.vectors).max()), float(np.abs(queries).max()))
        x, q = self.vectors / unit, queries / unit
        near = np.argpartition((x * x).sum(axis=1) - 2 * (q @ x.T), k - 1, axis=1)[:, :k]
        return np.sqrt(((x[near] - q[:, None, :]) ** 2).sum(axis=2)).max(axis=1) * unit * (1 + 1e-9)


def build_index(entries: DataFrame, kind: str = "<f8") -> DataFrame:
    """Index blocks of ``distinct_vectors``; near values of the first direction lie in the same block."""
    ordered = entries.repartitionByRange("dim", "lead").sortWithinPartitions("dim", "lead")
    return ordered.select("dim", "ids", "vector").mapInArrow(_blocks(BLOCK, _index_block, kind), INDEX)


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """dim, lead, vector, its ``most`` smallest ids and its number; more ids can't be among the nearest ``most``."""
    few = vectors.dropDuplicates(["vector", "vec_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id")))
    listed = few.where(F.col("nth") <= most).groupBy("vector").agg(F.first("dim").alias("dim"), F.first("lead").alias("lead"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return listed.withColumn("number", F.monotonically_increasing_id())


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in names}


def _search(k: int, seed: bool):
    """Each query of a block against an index block: what it found, or with ``seed`` a bound of its k-th distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "kind", "scale", "ids", "id_ends", "vectors", "values", "places", "q_block", "q_numbers", "q_vectors", "bounds"]
        for row in _rows(batches, names):
            block = Block(row)
            queries = np.frombuffer(row["q_vectors"], row["kind"]).reshape(-1, row["dim"]).astype(np.float64)
            numbers, at = np.frombuffer(row["q_numbers"], "<i8"), queries @ directions(row["dim"]).T
            if seed:
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]]), pa.array([block.bounds(queries, k).astype("<f8").tobytes()], pa.binary())], ["block", "bounds"])
            else:
                found = block.search(queries, at, k, np.frombuffer(row["bounds"], "<f8"))
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(numbers, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["number", "vec_id", "score"]
                )

    return run


def _pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Numbers of a query block and an index block of the same dimension, and the index block's place among them by chance."""
    slots = F.explode(F.array(*[F.lit(s) for s in range(SLOTS)])).alias("slot")
    left = queries.select(F.col("block").alias("q_block"), "dim", slots)
    right = index.select("block", "dim", F.pmod(F.hash("block"), F.lit(SLOTS)).alias("slot"))
    return left.join(right, ["dim", "slot"]).select("q_block", "block")


def _opened(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """The contents of both blocks of each pair."""
    asked = queries.select(F.col("block").alias("q_block"), F.col("numbers").alias("q_numbers"), F.col("vectors").alias("q_vectors"), "bounds")
    return pairs.join(asked, "q_block").join(index, "block")


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """number, vec_id and score of the k nearest rows found for each vector of query blocks."""
    pairs = cut_lineage(_pairs(queries, index))
    first = pairs.groupBy("q_block").agg(F.min_by("block", F.xxhash64("q_block", "block")).alias("block"))
    plain = queries.withColumn("bounds", F.lit(None).cast("binary"))
    bounds = cut_lineage(_opened(first, plain, index).mapInArrow(_search(k, True), "block long, bounds binary"))
    bounded = queries.join(bounds, "block")
    found = _opened(pairs, bounded, index).mapInArrow(_search(k, False), FOUND)
    order = Window.partitionBy("number").orderBy("score", "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each row that ``is_query`` (a condition on vec_id) picks."""
    vectors = whole_vectors(rows, id_col, vector_col)
    entries = cut_lineage(distinct_vectors(vectors, k + 1))
    kind = kind_of(rows, vector_col)
    index = cut_lineage(build_index(entries, kind))
    asking = vectors.where(is_query).select("vec_id", "vector").distinct()
    numbers = cut_lineage(asking.join(entries.select("vector", "number"), "vector").select("vec_id", "number"))
    asked = entries.join(numbers.select("number").distinct(), "number", "left_semi")
    blocks = asked.repartitionByRange("dim", "lead").sortWithinPartitions("dim", "lead").select("dim", "number", "vector")
    queries = cut_lineage(blocks.mapInArrow(_blocks(QUERIES, _query_block, kind), QUERY))
    # a vector's own row is among its k + 1 nearest, or k + 1 equal ones of smaller id are
    found = nearest(index, queries, k + 1)
    rest = numbers.withColumnRenamed("vec_id", "query_id").join(found, "number").where((F.col("vec_id") != F.col("query_id")) | (F.col("score") > 0))
    order = Window.partitionBy("query_id", "number").orderBy("score", "vec_id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
