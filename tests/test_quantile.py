"""Exact quantiles of several columns at once."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame

from tablecare.operators import quantile


def expected(values, q):
    data = sorted(v for v in values if v is not None and v == v)
    place = (len(data) - 1) * q
    low, high = float(data[int(place)]), float(data[min(int(place) + 1, len(data) - 1)])
    return low if low == high or place == int(place) else low + (high - low) * (place - int(place))


@pytest.mark.parametrize("small", [20, 20_000])
def test_all_columns_together(spark, monkeypatch, small):
    monkeypatch.setattr(quantile, "SMALL", small)
    r = random.Random(5)
    rows = [
        (r.gauss(0, 1), r.randint(-3, 3), r.choice([float("inf"), -float("inf"), 1.5, 2.5, float("nan"), None]), None, 10**17 + r.randint(0, 900), Decimal(r.randint(0, 10**6)).scaleb(-2))
        for _ in range(4000)
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e bigint, f decimal(12,2)")
    shares = [0.003, 0.5, 1.0]
    found = quantile.exact_quantiles(df, {c: shares for c in df.columns})
    assert found.pop("d") == [None] * len(shares)
    for i, c in enumerate(df.columns):
        if c in found:
            assert found[c] == pytest.approx([expected([row[i] for row in rows], q) for q in shares], nan_ok=True), c


def test_decimals_wider_than_doubles(spark, monkeypatch):
    """Thousands of values that are one double: they are ordered by tasks, not by the driver."""
    monkeypatch.setattr(quantile, "SMALL", 50)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    value = lambda i: Decimal(f"{10**30}.{i:04d}")
    rows = [(value(i),) for i in range(6000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "v decimal(38,4)")
    ranks = {}
    real = quantile._ordered
    monkeypatch.setattr(quantile, "_ordered", lambda df, r: (real(df, r), ranks.update({r.rank: r.value})))
    quantile.exact_quantiles(df, {"v": [0.25, 0.5]})
    assert ranks and all(v == value(k) for k, v in ranks.items())


def test_scans_stay_few(spark, monkeypatch):
    """Sketch, confirmation, count: three actions for many rows of several columns, whatever their spread."""
    actions, kind = [], type(spark.range(1))
    for name in ("first", "collect"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name), n=name: (actions.append(n), f(self))[1])
    df = spark.range(0, 400_000, 1, 8).selectExpr("(id * 7919) % 1000003 AS a", "CAST(id % 13 AS double) AS b", "pow(10, id % 300) AS c", "id / 7 AS d")
    found = quantile.exact_quantiles(df, {c: [0.5] for c in df.columns})
    assert found["b"] == [6.0] and found["d"] == [pytest.approx(199_999.5 / 7)]
    assert actions.count("first") <= 3 and len(actions) <= 8  # first is made of head and collect


def test_no_columns_and_wrong_kinds(spark):
    assert quantile.exact_quantiles(spark.range(3), {}) == {}
    with pytest.raises(TypeError):
        quantile.exact_quantiles(spark.createDataFrame([("x",)], "v string"), {"v": [0.5]})


def test_ranges_confirmed_without_sketches(spark, monkeypatch):
    """Ranges of a column part its values into classes: a row is met once, however many ranges there are."""
    sketches, real = [], quantile.F.percentile_approx
    monkeypatch.setattr(quantile.F, "percentile_approx", lambda *args: (sketches.append(args), real(*args))[1])
    data = [(i * 7919) % 30_011 // 3 for i in range(30_011)]
    df = spark.createDataFrame([(v,) for v in data], "v bigint")
    shares = [k / 60 for k in range(61)]
    assert quantile.exact_quantiles(df, {"v": shares})["v"] == pytest.approx([expected(data, q) for q in shares])
    assert len(sketches) == 1
