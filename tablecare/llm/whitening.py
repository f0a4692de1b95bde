"""Whitening of embeddings by polarisation: covariances out of variances alone.

Entries become whole numbers x = floor(``scale`` * entry).  Over the list of
distinct x-vectors, tasks add up exactly the squares of y = n*x - S for every
dimension and of y_i + y_j for every pair of dimensions (S: sums, n: vectors).
As (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, the differences of these
variances are the covariances; only they, bounded by the dimension, come to
the driver, which takes their eigenvectors.

Sums are whole numbers of any size, so neither the order of rows nor their
number changes them.

Defined cases: vectors that are null or hold null or non-finite entries, or an
entry whose x doesn't fit in 64 bits, take no part; empty ones have no
component and so no row.  Vectors of different dimension are whitened apart,
each dimension with its own n.  Repeated vectors count once in the fit and each
gets its rows, as do rows without or with equal ids.  Where a component has no
variance its whitened value is null, as is the explained share of a list
without any.  A deviation of over 38 digits is null.  An empty table gives no
rows.  A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.texts import ship
from tablecare.llm.vectors import finite, packed, unpacked
from tablecare.sources.session import cut_lineage

SCALE = 256
SCALED = "vec_id long, dim int, x binary"
#: A whole number of any size as hi * 2^LOW + lo, so that both columns can be added up.
LOW = 40
#: Vectors whose squares are added up before the sum is carried over into whole numbers of any size.
BLOCK = 4096
#: Bits of a limb whose squares, BLOCK of them, fit in 63 bits.
LIMB = 25


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim and x as integers of the least of 16, 32 and 64 bits, so equal vectors have equal bytes."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, matrix in finite(batch.column("v")):
                with np.errstate(over="ignore"):
                    x = np.floor(matrix * scale)
                size = np.abs(x).max(axis=1)
                for least, below, kind in ((0, 2**15, "<i2"), (2**15, 2**31, "<i4"), (2**31, 2.0**63, "<i8")):
                    fit = np.flatnonzero((size >= least) & (size < below))
                    if len(fit):
                        dims = pa.array(np.full(len(fit), matrix.shape[1], np.int32))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[fit])), dims, packed(x[fit].astype(kind)).cast(pa.binary())], ["vec_id", "dim", "x"])

    picked = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec_id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    return picked.mapInArrow(run, SCALED)


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x-vectors of each dimension and width."""
    dims = batch.column("dim").to_numpy()
    column = batch.column("x").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    sizes = np.diff(bounds)
    for dim, size in np.unique(np.stack([dims, sizes]), axis=1).T.tolist() if len(dims) else []:
        rows = np.flatnonzero((dims == dim) & (sizes == size))
        for start in range(0, len(rows), BLOCK):
            part = rows[start : start + BLOCK]
            yield part, unpacked(column, part, f"<i{size // dim}", dim).astype(np.int64)


@dataclass
class Whitening:
    """What vectors of one dimension have learnt: counts, sums, and components by falling variance."""

    dim: int
    n: int
    sums: list[int]
    most: int
    variances: np.ndarray | None = None
    components: np.ndarray | None = None
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: 64-bit integers where they hold it and the sum of two, else Python's."""
        if self.bits() <= 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def bits(self) -> int:
        """Of a sum of two centred entries."""
        return (4 * self.n * self.most).bit_length()

    def squares(self, z: np.ndarray) -> list[int]:
        """The exact sum of squares of each row of at most ``BLOCK`` centred entries or sums of two."""
        if self.bits() <= LIMB:
            return np.einsum("ij,ij->i", z, z).tolist()
        if self.bits() <= 2 * LIMB:
            high, low = z >> LIMB, z & ((1 << LIMB) - 1)
            parts = (np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
            return [(a << 2 * LIMB) + (b << LIMB + 1) + c for a, b, c in zip(*parts, strict=True)]
        return [sum(v * v for v in row) for row in z.tolist()]

    def solve(self, squares: dict[tuple[int, int], int]) -> None:
        """Components of the covariance that the squares of sums and of single dimensions give."""
        cov = np.zeros((self.dim, self.dim))
        for (i, j), total in squares.items():
            own = total if i == j else (total - squares[i, i] - squares[j, j]) // 2
            cov[i, j] = cov[j, i] = own / self.n**3
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1].T
        largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
        self.components = vectors * np.where(largest < 0, -1.0, 1.0)
        self.trace = float(np.trace(cov))
        self.variances = np.where(values > self.dim * np.finfo(float).eps * max(values[0], 0), values, 0.0)

    def deviations(self, y: np.ndarray) -> pa.Array:
        """The exact sum of squares of each row."""
        if y.dtype == np.int64 and 2 * (self.bits() - 1) + self.dim.bit_length() <= 63:
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        found = [sum(v * v for v in row) for row in y.tolist()]
        return pa.array([v if v < 10**38 else None for v in found], pa.decimal128(38, 0))

    def whitened(self, y: np.ndarray, k: int) -> np.ndarray:
        """Centred vectors on the first k components, over their standard deviations; NaN without variance."""
        k = min(k, self.dim)
        deviation = np.sqrt(np.where(self.variances[:k] > 0, self.variances[:k], np.nan))
        return (y / self.n).astype(np.float64) @ self.components[:k].T / deviation


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each dimension of a task's vectors: how many, their sum, the largest entry."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _whole(batch):
            one = found.setdefault(x.shape[1], [0, [0] * x.shape[1], 0])
            one[0] += len(x)
            halves = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            one[1] = [a + (h << 32) + b for a, h, b in zip(one[1], *halves, strict=True)]
            one[2] = max(one[2], -int(x.min()), int(x.max()))
    rows = [(dim, i, n, total, most) for dim, (n, sums, most) in found.items() for i, total in enumerate(sums)]
    yield _numbers([(d, i, i, total, n, most) for d, i, n, total, most in rows])


NUMBERS = "dim int, i int, j int, hi decimal(38,0), lo long, n long, most decimal(38,0)"


def _numbers(rows: list[tuple[int, int, int, int, int, int]]) -> pa.RecordBatch:
    d, i, j, total, n, most = zip(*rows, strict=True) if rows else [()] * 6
    big = pa.decimal128(38, 0)
    columns = [pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([t >> LOW for t in total], big)]
    columns += [pa.array([t & ((1 << LOW) - 1) for t in total], pa.int64()), pa.array(n, pa.int64()), pa.array(most, big)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NUMBERS.split(", ")])


def _added(numbers: DataFrame) -> Iterator[tuple]:
    """dim, i, j, sum, n and largest entry over all tasks."""
    sums = numbers.groupBy("dim", "i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("n").alias("n"), F.max("most").alias("most"))
    for r in sums.collect():  # bounded by the square of the dimension
        yield r["dim"], r["i"], r["j"], (int(r["hi"]) << LOW) + r["lo"], r["n"], int(r["most"])


def _pair_squares(models: dict[int, Whitening]):
    """A row for each dimension and pair of dimensions of a task's vectors: the sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list[int]]] = {}
        for batch in batches:
            for _, x in _whole(batch):
                model = models[x.shape[1]]
                y = np.ascontiguousarray(model.centred(x).T)
                sums = found.setdefault(model.dim, [[0] * (model.dim - i) for i in range(model.dim)])
                for i in range(model.dim):
                    z = y[i:] + y[i]
                    z[0] = y[i]
                    sums[i] = [a + b for a, b in zip(sums[i], model.squares(z), strict=True)]
        yield _numbers([(d, i, i + k, total, 0, 0) for d, sums in found.items() for i, row in enumerate(sums) for k, total in enumerate(row)])

    return run


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """A whitening for each dimension of the distinct x-vectors of ``scaled``."""
    models: dict[int, Whitening] = {}
    for dim, i, _, total, n, most in _added(vectors.select("dim", "x").mapInArrow(_sums, NUMBERS)):
        model = models.setdefault(dim, Whitening(dim, n, [0] * dim, 0))
        model.sums[i], model.most = total, max(model.most, most)
    squares: dict[int, dict] = {d: {} for d in models}
    if models:
        for dim, i, j, total, _, _ in _added(vectors.select("dim", "x").mapInArrow(_pair_squares(models), NUMBERS)):
            squares[dim][i, j] = total
    for dim, model in models.items():
        model.solve(squares[dim])
    return models


def apply(vectors: DataFrame, models: dict[int, Whitening], k: int) -> DataFrame:
    """vec_id, dim, deviation and the first k whitened values of rows of ``scaled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _whole(batch):
                model = models[x.shape[1]]
                y = model.centred(x)
                values = model.whitened(y, k)
                bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1])
                lists = pa.ListArray.from_arrays(bounds, pa.array(values.reshape(-1), from_pandas=True))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("dim").take(at), model.deviations(y), lists], ["vec_id", "dim", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, dim int, deviation decimal(38,0), whitened array<double>")


def identity_errors(vectors: DataFrame, models: dict[int, Whitening], k: int) -> dict[int, float | None]:
    """For each dimension the largest absolute entry of the whitened values' covariance minus the identity."""
    values = apply(vectors.select(F.lit(None).cast("long").alias("vec_id"), "dim", "x"), models, k)
    w = [F.get("whitened", F.lit(a)) for a in range(k)]
    errors = [F.abs(F.covar_pop(w[a], w[b]) - float(a == b)) for a in range(k) for b in range(a, k)]
    worst = F.array_max(F.array(*errors))
    return {r["dim"]: r["worst"] for r in values.groupBy("dim").agg(worst.alias("worst")).collect()}


def whiten(rows: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each vector and component up to ``k``: n, deviation, whitened, explained and identity_error."""
    vectors = scaled(rows, id_col, vector_col, scale)
    listed = cut_lineage(vectors.select("dim", "x").distinct())
    models = fit(listed)
    errors = identity_errors(listed, models, k) if models else {}
    facts = [
        (d, m.n, errors.get(d), c + 1, float(max(m.variances[c], 0.0) / m.trace) if m.trace > 0 else None)
        for d, m in models.items()
        for c in range(min(k, d))
    ]
    known = rows.sparkSession.createDataFrame(facts, "dim int, n long, identity_error double, component int, explained double")
    found = apply(vectors, models, k).select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    found = found.withColumn("component", F.col("at") + 1).drop("at")
    return found.join(F.broadcast(known), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
