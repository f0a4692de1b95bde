"""Exact order statistics and modes without gathering a column in one task."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.hashing import clean_value, quoted
from tablecare.sources.session import cut_lineage

# Cuts of a range in a round; a round narrows it to about four of them.
BUCKETS = 250
# Few enough rows of a range to bring their distinct values to the driver as (value, count) pairs.
SMALL = 20_000
# Rounds after which a rank is looked for by ordering its range.
ROUNDS = 6
# Ranks of a sketch are off by at most this share of the rows; a range that turns out wrong is left again.
ACCURACY = 10_000


@dataclass
class _Rank:
    """A 0-based rank of a column: it lies in [least, most] for certain, in [low, high] by the sketch."""

    column: str
    rank: int
    least: object
    most: object
    low: object
    high: object
    below: int = 0
    inside: int = 0
    rounds: int = 0
    state: str = "open"
    value: object = None

    def range(self) -> tuple:
        return self.low, self.high

    def narrow(self, classes: list) -> None:
        """Takes in the class of values that holds the rank, of all classes in order."""
        self.rounds += 1
        ends = list(accumulate(n for n, _, _ in classes))
        at = bisect_right(ends, self.rank)
        self.inside, self.least, self.most = classes[at]
        self.below, self.low, self.high = ends[at] - self.inside, self.least, self.most
        if self.least == self.most:
            self.state, self.value = "found", self.least
        elif self.inside <= SMALL:
            self.state = "few"
        elif self.rounds > ROUNDS:
            # a sketch that leads astray this often has more rows than doubles to tell them apart
            self.state = "dense"

    def cut(self, cuts: list) -> None:
        """Goes on with the part of the range that holds the rank by a sketch of it."""
        place = (self.rank - self.below) / self.inside * BUCKETS
        first, last = math.floor(place) - 2, math.ceil(place) + 2
        self.low = self._within(cuts[first]) if first > 0 else self.least
        self.high = self._within(cuts[last]) if last < BUCKETS else self.most

    def _within(self, cut):
        """The cut, or the nearer end where rounding took it out of the range."""
        return max(self.least, min(cut, self.most))


def _values(df: DataFrame, column: str) -> Column:
    return clean_value(df.schema[column])


def _bounded(df: DataFrame, column: str, low, high) -> Column:
    """Whether a row's value is in the range."""
    kind = df.schema[column].dataType
    return _values(df, column).between(F.lit(low).cast(kind), F.lit(high).cast(kind))


def _by_column(ranks: list[_Rank]) -> dict[str, list[_Rank]]:
    out: dict[str, list[_Rank]] = {}
    for r in ranks:
        out.setdefault(r.column, []).append(r)
    return out


def _collected(results: dict[str, DataFrame]) -> dict[str, list[Row]]:
    """Rows of small results of several columns, each in its own types, from one job that reads every column apart."""
    parts = []
    for c, found in results.items():
        kinds = {k: other.schema.simpleString() for k, other in enumerate(results.values()) if other is not found}
        own = F.struct(*found.columns)
        parts.append(found.select(F.lit(c).alias("c"), *[(F.lit(None).cast(kinds[k]) if k in kinds else own).alias(f"r{k}") for k in range(len(results))]))
    out: dict[str, list[Row]] = {c: [] for c in results}
    place = {c: k + 1 for k, c in enumerate(results)}
    for row in reduce(DataFrame.unionAll, parts).collect():
        out[row["c"]].append(row[place[row["c"]]])
    return out


def _class(value: Column, points: list[Column], first: int = 0) -> Column:
    """Where a value lies among ordered points: 2k + 1 at the k-th of them, 2k between the one before and it; found by halving."""
    if not points:
        return F.lit(2 * first)
    k = len(points) // 2
    below, above = _class(value, points[:k], first), _class(value, points[k + 1 :], first + k + 1)
    return F.when(value < points[k], below).when(value == points[k], F.lit(2 * (first + k) + 1)).otherwise(above)


def _starts(df: DataFrame, shares: dict[str, list[float]]) -> tuple[dict[str, int], list[_Rank]]:
    """How many values each column has, and its ranks with ranges from one sketch a column."""
    slack, wanted = 2 / ACCURACY, []
    for i, (c, qs) in enumerate(shares.items()):
        v = _values(df, c)
        ends = [e for q in qs for e in (max(0.0, q - slack), min(1.0, q + slack))]
        sketch = F.percentile_approx(v, F.array(*map(F.lit, ends)), ACCURACY)
        wanted.append(F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), sketch.alias("ends")).alias(f"c{i}"))
    row, counts, ranks = df.agg(*wanted).first(), {}, []
    for i, (c, qs) in enumerate(shares.items()):
        found = row[f"c{i}"]
        counts[c] = n = found["n"]
        for k, q in enumerate(qs if n else ()):
            low, high = found["ends"][2 * k : 2 * k + 2]
            low, high = (found["low"] if q <= slack else low), (found["high"] if q >= 1 - slack else high)
            for place in sorted({math.floor((n - 1) * q), math.ceil((n - 1) * q)}):
                one = _Rank(c, place, found["low"], found["high"], low, high)
                if n <= SMALL:
                    one.low, one.high, one.inside, one.state = one.least, one.most, n, "few"
                ranks.append(one)
    return counts, ranks


def _narrowed(df: DataFrame, ranks: list[_Rank]) -> None:
    """The ends of a column's ranges part its values into classes, which one scan counts; ranges still large are cut by a sketch of their rows."""
    counted = {}
    for c, own in _by_column(ranks).items():
        kind = df.schema[c].dataType
        points = [F.lit(p).cast(kind) for p in sorted({p for r in own for p in r.range()})]
        values = df.select(_values(df, c).alias("v")).where("v is not null")
        counted[c] = values.groupBy(_class(F.col("v"), points).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    classes = {c: [(r["n"], r["first"], r["last"]) for r in sorted(rows, key=lambda r: r["class"])] for c, rows in _collected(counted).items()}
    for r in ranks:
        r.narrow(classes[r.column])
    cut, ranges = {}, {}
    for c, own in _by_column([r for r in ranks if r.state == "open"]).items():
        ranges[c] = list({r.range(): None for r in own})
        inside = [_bounded(df, c, *key) for key in ranges[c]]
        shares = F.array(*[F.lit(k / BUCKETS) for k in range(BUCKETS + 1)])
        sketches = [F.percentile_approx(F.when(i, _values(df, c)), shares, ACCURACY) for i in inside]
        cut[c] = df.where(reduce(Column.__or__, inside)).agg(F.array(*sketches).alias("cuts"))
    if not cut:
        return
    found = _collected(cut)
    for r in ranks:
        if r.state == "open":
            r.cut(found[r.column][0]["cuts"][ranges[r.column].index(r.range())])


def _counted(df: DataFrame, ranks: list[_Rank]) -> None:
    """One job counts the values of all ranges of few rows, each column read once; the ranks are read off."""
    counts = {}
    for c, own in _by_column(ranks).items():
        inside = reduce(Column.__or__, [_bounded(df, c, *key) for key in {r.range(): None for r in own}])
        counts[c] = df.where(inside).groupBy(_values(df, c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = {c: sorted((row["v"], row["n"]) for row in rows) for c, rows in _collected(counts).items()}
    for r in ranks:
        before, counted = r.below, found[r.column]
        for value, n in counted[bisect_left(counted, r.low, key=lambda x: x[0]) :]:
            before += n
            if r.rank < before:
                r.value = value
                break


def _ordered(df: DataFrame, rank: _Rank) -> None:
    """A rank among many values that a double can't tell apart: their counts in order, and in the part that holds it a running sum."""
    v = _values(df, rank.column)
    counts = df.where(_bounded(df, rank.column, rank.low, rank.high)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parted = cut_lineage(counts.orderBy("v").withColumn("part", F.spark_partition_id()))
    low = F.lit(rank.low).cast(df.schema[rank.column].dataType)
    before = df.agg(F.count_if(v < low).alias("n")).first()["n"]
    for part in parted.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each part
        if rank.rank < before + part["n"]:
            break
        before += part["n"]
    running = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    own = parted.where(F.col("part") == part["part"]).withColumn("up_to", running + before)
    rank.value = own.where((F.col("up_to") > rank.rank) & (F.col("up_to") - F.col("n") <= rank.rank)).first()["v"]


def exact_quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, nulls and NaN left out; None for a column without values.

    All columns are narrowed together: sketches give ranges of values that hold
    the ranks, counts of the classes between their ends confirm them, and the few
    rows that are left are counted by value.  Each round reads a column once, and
    again where ranges are still large; three to five scans do for any number of rows.
    """
    for c in shares:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"not a numeric column: {c}")
    if not shares:
        return {}
    df = df.select(*[F.col(quoted(c)) for c in shares])
    counts, ranks = _starts(df, shares)
    while still := [r for r in ranks if r.state == "open"]:
        _narrowed(df, still)
    if few := [r for r in ranks if r.state == "few"]:
        _counted(df, few)
    for r in ranks:
        if r.state == "dense":
            _ordered(df, r)
    found = {(r.column, r.rank): float(r.value) for r in ranks}
    out: dict[str, list[float | None]] = {}
    for c, qs in shares.items():
        places = [(counts[c] - 1) * q for q in qs]
        out[c] = [_between(found[c, math.floor(p)], found[c, math.ceil(p)], p - math.floor(p)) for p in places] if counts[c] else [None] * len(qs)
    return out


def _between(first: float, last: float, share: float) -> float:
    return first if first == last else first + (last - first) * share


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linearly interpolated quantile of a numeric column, nulls and NaN left out."""
    return exact_quantiles(df, {column: [q]})[column][0]


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: found[0] for c, found in exact_quantiles(df, {c: [0.5] for c in columns}).items()}


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantile(df, column, 0.5)


def mode_rows(df: DataFrame, column: str) -> DataFrame:
    """One row (value, n): the most frequent non-null value, the smallest among ties."""
    value = clean_value(df.schema[column])
    return (
        df.select(value.alias("value")).filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value").limit(1)
    )
