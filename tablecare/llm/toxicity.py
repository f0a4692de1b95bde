"""Toxicity scores by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits, and the first five bytes of
longer ones; both are hashed into ``BUCKETS`` buckets, a text having a bucket
or not, and another bucket if it has the term more than once.  Buckets are chosen by how unevenly toxic and other training texts
have them (log-likelihood ratio, counted over all training rows); the machine
learns a weight for each and, in ``FACTORS`` dimensions, for each pair of them,
so that two terms together can tell what neither tells alone.

It is fitted on at most about ``SAMPLE`` labelled rows, picked by a hash of the
id; choice of terms and scoring cover all rows.

Defined cases: a null or empty text, and one without chosen terms, gets the
score of the bias; rows labelled twice count twice, null labels not at all;
without any label, or with one kind only, all scores are the smoothed share of
toxic rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.texts import Words, id_and_text, ship, slices
from tablecare.sources.session import cut_lineage

BUCKETS = 1 << 20
#: Log-likelihood ratio that a bucket needs, the same test of significance at every size.
RATIO = 12.0
SAMPLE = 60_000
FACTORS, ROUNDS, RATE = 6, 250, 0.08
#: Pull of weights and factors towards zero, in rows.
RIDGE, RIDGE_PAIRS = 0.05, 20.0
#: Part of the terms that each round of fitting sees, so that one of several telling terms is enough.
KEPT = 0.7
#: Terms of texts that a round of fitting holds at a time; no result depends on it but by rounding.
PLACES = 500_000
THRESHOLD = 0.7
PREFIX = 5
#: Odd factor that gives a bucket of its own to a term that a text has more than once.
AGAIN = 0x2545F491

#: Bytes between terms: ASCII but letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets in order, text after text, and the bounds of the texts."""
    words = Words(texts, APART)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    long = words.last - words.first > PREFIX
    starts = words.spans(words.first[long], words.first[long] + PREFIX) * np.uint64(0x9E3779B97F4A7C15)
    bucket = np.concatenate([words.hash, starts ^ (starts >> np.uint64(32))]) % np.uint64(BUCKETS)
    each, times = np.unique(np.concatenate([owner, owner[long]]) * BUCKETS + bucket.astype(np.int64), return_counts=True)
    again = each[times > 1]
    again = again - again % BUCKETS + (again * AGAIN) % BUCKETS
    both = np.unique(np.concatenate([each, again]))
    return both % BUCKETS, np.searchsorted(both // BUCKETS, np.arange(len(texts) + 1))


@dataclass
class Machine:
    """Chosen buckets in order, bias, weights and factors."""

    chosen: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        buckets, bounds = terms(texts)
        return self.of(*_only(self.chosen, buckets, bounds))

    def of(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of texts given as places of their buckets among the chosen."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return _sigmoid(_raw(self.bias, self.weights, self.factors, places, owner, len(bounds) - 1)[0])

    @classmethod
    def fitted(cls, chosen: np.ndarray, places: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, seed: int = 7) -> Machine:
        """Log-loss descent over all given rows, some at a time in memory, with steps scaled by running moments."""
        n = len(toxic)
        share = (toxic.sum() + 0.5) / (n + 1)
        values = [np.array([np.log(share / (1 - share))]), np.zeros(len(chosen)), np.random.default_rng(seed).normal(0, 0.05, (len(chosen), FACTORS))]
        if not len(places) or not 0 < toxic.sum() < n:
            return cls(chosen, values[0][0], values[1], values[2] * 0)
        first, second = [v * 0 for v in values], [v * 0 for v in values]
        random = np.random.default_rng(seed)
        cuts = np.unique([*np.searchsorted(bounds, np.arange(0, bounds[-1], PLACES)), n])
        for step in range(1, ROUNDS + 1):
            missed, weights, factors = 0.0, RIDGE * values[1], RIDGE_PAIRS * values[2]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, owner = places[bounds[a] : bounds[b]], np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                kept = random.random(len(own)) < KEPT
                own, owner = own[kept], owner[kept]
                raw, sums = _raw(values[0][0], values[1], values[2], own, owner, b - a)
                miss = _sigmoid(raw) - toxic[a:b]
                missed += miss.sum()
                each = np.bincount(own, miss[owner], len(chosen))
                weights += each
                for k in range(FACTORS):
                    factors[:, k] += np.bincount(own, (miss * sums[:, k])[owner], len(chosen)) - each * values[2][:, k]
            for v, m, s, g in zip(values, first, second, (np.array([missed]), weights, factors), strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return cls(chosen, float(values[0][0]), values[1], values[2])


def _raw(bias: float, weights: np.ndarray, factors: np.ndarray, places: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias, weights and half of (square of sums less sum of squares) of the factors; the sums by text."""
    sums = np.column_stack([np.bincount(owner, f[places], n) for f in np.ascontiguousarray(factors.T)])
    own = weights - 0.5 * (factors * factors).sum(1)
    return bias + np.bincount(owner, own[places], n) + 0.5 * (sums * sums).sum(1), sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _only(chosen: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the buckets that are chosen, and the bounds of the texts among those."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    at = np.minimum(np.searchsorted(chosen, buckets), len(chosen) - 1)
    kept = chosen[at] == buckets
    return at[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def fold(id_column) -> F.Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted on the labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    marks = labels.select(labels[f"`{id_col}`"].cast("long").alias("doc_id"), labels[f"`{label_col}`"].cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
    rows = id_and_text(docs, id_col, text_col).where(fold(F.col("doc_id")) != 1).join(marks.hint("merge"), "doc_id")  # alike at every size
    known = cut_lineage(rows.mapInArrow(_packed, "doc_id long, toxic int, buckets binary"))
    total, bad = known.agg(F.count("*"), F.sum("toxic")).first()
    bad = bad or 0
    chosen = np.zeros(0, np.int64)
    if 0 < bad < total:
        counts = known.select("toxic", "buckets").mapInArrow(_counted, "bucket int, toxic long, others long").groupBy("bucket")
        ratio = _ratio(F.col("a"), F.col("b"), float(bad), float(total - bad))
        best = counts.agg(F.sum("toxic").alias("a"), F.sum("others").alias("b")).where(ratio >= RATIO)  # BUCKETS rows at most
        chosen = np.sort(best.select("bucket").toArrow().column("bucket").to_numpy().astype(np.int64))
    part = min(1.0, sample / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else known
    found = picked.select("toxic", "buckets").mapInArrow(_chosen(chosen), "toxic int, places array<int>").toArrow()
    places, sizes = [], []
    for x in found.column("places").chunks:
        places.append(x.flatten().to_numpy(zero_copy_only=False))
        sizes.append(x.value_lengths().to_numpy(zero_copy_only=False))
    flat = np.concatenate([np.zeros(0, np.int32), *places])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
    toxic = found.column("toxic").to_numpy().astype(float)
    return Machine.fitted(chosen, flat, bounds, (toxic > 0).astype(float))


def _ratio(a, b, bad: float, good: float):
    """Log-likelihood ratio of a bucket that a toxic and b other texts have."""
    share, total = (a + b) / F.lit(bad + good), bad + good
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    with_ = term(a, share * bad) + term(b, share * good)
    without = term(F.lit(bad) - a, (1 - share) * bad) + term(F.lit(good) - b, (1 - share) * good)
    return 2 * (with_ + without) if total else F.lit(0.0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            buckets, bounds = terms(piece.column("text"))
            buckets = buckets.astype("<u4")
            packed = [buckets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), pa.array(packed, pa.binary())], ["doc_id", "toxic", "buckets"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each kind have each bucket, summed by task."""
    sums = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for kind in (0, 1):
            packed = batch.column("buckets").filter(pa.array(toxic == bool(kind)))
            if len(packed):
                sums[kind] += np.bincount(np.frombuffer(b"".join(packed.to_pylist()), "<u4"), minlength=BUCKETS)
    seen = np.flatnonzero(sums.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[1][seen]), pa.array(sums[0][seen])], ["bucket", "toxic", "others"])


def _chosen(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("buckets").to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)
            places, bounds = _only(chosen, np.frombuffer(b"".join(packed), "<u4").astype(np.int64), bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "places"])

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = machine.score(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                yield piece.filter(pa.array(machine.score(piece.column(place).cast(pa.large_string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
