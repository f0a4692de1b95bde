import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecare.operators import clean, dryrun, ordered, quantile


def values(df, column):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda v: (v is None, v))


@pytest.fixture()
def holes(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", 1), (2, None, "b", 2), (3, 3.0, None, 10), (4, 5.0, "b", None), (5, float("nan"), "a", 4)],
        "k int, x double, s string, n int",
    )


def test_fills(holes):
    assert values(clean.fill_mean(holes, ["x"]), "x") == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert values(clean.fill_median(holes, ["n"]), "n") == [1, 2, 3, 4, 10]
    # a and b are equally frequent: the smaller wins
    assert values(clean.fill_mode(holes, ["s"]), "s") == ["a", "a", "a", "b", "b"]
    assert values(clean.fill_constant(holes, {"n": 0, "s": "?"}), "n") == [0, 1, 2, 4, 10]
    assert clean.drop_null_rows(holes, ["s", "n"]).count() == 3
    assert values(clean.flag_nulls(holes, ["x"]), "x_was_null") == [False, False, False, True, True]


def test_fill_of_an_empty_column_stays_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    for fill in (clean.fill_mean, clean.fill_median, clean.fill_mode):
        assert values(fill(df, ["x"]), "x") == [None, None]


def test_column_drops(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, None, "c"), (3, 1, "c"), (4, 2, "c")], "k int, half int, one string")
    assert clean.drop_sparse_columns(df).columns == ["k", "half", "one"]
    assert clean.drop_sparse_columns(df, above_percent=49).columns == ["k", "one"]
    assert clean.drop_constant_columns(df).columns == ["k", "half"]


def test_dedup(spark):
    df = spark.createDataFrame(
        [(3, "a", None), (1, "a", None), (2, "b", "x"), (4, None, "x"), (5, None, "x"), (2, "b", "x")],
        "k int, s string, t string",
    )
    assert clean.dedup_exact(df).count() == 5
    assert clean.dedup_exact(clean.dedup_exact(df)).count() == 5
    kept = clean.dedup_keep_first(df, ["s", "t"], ["k"])
    assert values(kept, "k") == [1, 2, 4]
    assert values(clean.keep_last(df, ["s"], ["k"]), "k") == [2, 3, 5]


def test_keep_first_drops_copies_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 2 AS string) AS s")
    plan = clean.dedup_keep_first(df, ["s"], ["id"])._jdf.queryExecution().executedPlan().toString()
    # the plan prints top down: the partial limit is below the exchange
    assert "WindowGroupLimit" in plan[plan.index("Exchange hashpartitioning"):]


def test_safe_cast(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("n/a",), ("1d",), (None,)], "v string")
    assert values(clean.safe_cast(df, {"v": "double"}), "v") == [1.0, 2.5, None, None, None]
    assert tuple(clean.cast_rejects(df, {"v": "double"}).first()) == ("v", 4, 2)


@pytest.fixture()
def spread(spark):
    rows = [(i, float(i % 10)) for i in range(200)] + [(200, 1000.0), (201, -1000.0), (202, None)]
    return spark.createDataFrame(rows, "k int, v double")


def test_outliers(spread):
    data = pd.Series([r["v"] for r in spread.collect()]).dropna()
    low, high = data.mean() - 5 * data.std(), data.mean() + 5 * data.std()
    flagged = {r["k"] for r in clean.flag_outliers(spread, "v").filter("v_is_outlier").collect()}
    assert flagged == {200, 201}
    capped = {r["k"]: r["v"] for r in clean.cap_outliers(spread, ["v"]).collect()}
    assert capped[200] == pytest.approx(high) and capped[201] == pytest.approx(low)
    assert capped[202] is None and capped[5] == 5.0
    assert clean.remove_outliers(spread, "v").count() == 201


def test_outliers_of_one_value(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert clean.cap_outliers(df, ["v"]).first()["v"] == 5.0
    assert clean.remove_outliers(df, "v").count() == 1
    assert clean.flag_outliers(df, "v").first()["v_is_outlier"] is False


def test_clip(spark):
    df = spark.createDataFrame([(-1, -2.5), (3, None)], "a int, b double")
    rows = [tuple(r) for r in clean.clip_negative(df, ["a", "b"]).collect()]
    assert rows == [(0, 0.0), (3, None)]


def test_constraints(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "a int")
    checks = {"positive": F.col("a") > 0, "small": F.coalesce(F.col("a"), F.lit(0)) < 5}
    rows = {r["constraint"]: (r["ok"], r["violating_rows"]) for r in clean.assert_constraints(df, checks, 5).collect()}
    assert rows == {"row_count": (False, 2), "positive": (False, 2), "small": (True, 0)}
    with pytest.raises(clean.ConstraintError, match="positive"):
        clean.assert_constraints(df, checks, fail=True)


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "k int, v string")
    batch = spark.createDataFrame([(2, "new", 1), (4, "first", 1), (4, "last", 2)], "k int, v string, seq int")
    batch = clean.keep_last(batch, ["k"], ["seq"]).drop("seq")
    once = clean.upsert(target, batch, ["k"])
    want = [(1, "old"), (2, "new"), (3, "old"), (4, "last")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, clean.upsert(once, batch, ["k"]).collect())) == want


# order statistics

@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("make", [
    lambda r: [r.random() for _ in range(3001)],
    lambda r: [r.randint(0, 3) * 1.0 for _ in range(3000)],
    lambda r: [r.gauss(0, 1) * 10 ** r.randint(-8, 8) for _ in range(3000)],
    lambda r: [float("inf")] * 900 + [float("-inf")] * 1000 + [r.random() for _ in range(1100)],
    lambda r: [7.0] * 2500 + [r.random() * 1e-300 for _ in range(500)],
])
def test_exact_quantile(spark, monkeypatch, make, q):
    monkeypatch.setattr(quantile, "SMALL", 50)
    monkeypatch.setattr(quantile, "BUCKETS", 16)
    data = make(random.Random(1))
    df = spark.createDataFrame([(v,) for v in data] + [(None,), (float("nan"),)], "v double")
    ordered_data, place = sorted(data), (len(data) - 1) * q
    low, high = ordered_data[int(place)], ordered_data[min(int(place) + 1, len(data) - 1)]
    got = quantile.exact_quantile(df, "v", q)
    if low == high or place == int(place):
        assert got == low or (got != got and low in (float("inf"), float("-inf")))
    else:
        assert got == pytest.approx(low + (high - low) * (place - int(place)))


def test_exact_median_of_large_integers(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL", 10)
    data = [2**53 + i for i in range(101)]
    df = spark.createDataFrame([(v,) for v in data], "v bigint")
    assert quantile.exact_median(df, "v") == float(statistics.median(data))


# ordered operators over a hot key

@pytest.fixture()
def sequence(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        key = None if i % 50 == 0 else ("hot" if i % 3 else f"k{r.randint(0, 20)}")
        rows.append((key, r.randint(0, 400), i, None if r.random() < 0.6 else r.randint(0, 9)))
    return spark.createDataFrame(rows, "key string, t int, id int, v int")


def _expected(df):
    frame = df.toPandas().sort_values(["t", "id"])
    frame["key"] = frame["key"].fillna("<null>")
    groups = frame.groupby("key", sort=False)
    return frame.assign(
        filled=groups["v"].ffill(), previous=groups["id"].shift(1), position=groups.cumcount()
    ).set_index("id")


def _same(got, want):
    return all((a is None and pd.isna(b)) or a == b for a, b in zip(got, want))


@pytest.mark.parametrize("chunks", [None, 2, 64, 300])
def test_chunked_windows_match_whole_key_windows(sequence, chunks):
    want = _expected(sequence)
    order = ["t", "id"]
    filled = {r["id"]: r["v"] for r in ordered.forward_fill(sequence, ["key"], order, ["v"], chunks).collect()}
    previous = {r["id"]: r["p"] for r in ordered.with_previous(sequence, ["key"], order, "id", "p", chunks).collect()}
    position = {r["id"]: r["seq"] for r in ordered.with_position(sequence, ["key"], order, "seq", chunks).collect()}
    ids = list(want.index)
    assert len(filled) == len(previous) == len(position) == len(ids)
    assert _same([filled[i] for i in ids], want["filled"])
    assert _same([previous[i] for i in ids], want["previous"])
    assert _same([position[i] for i in ids], want["position"])


def test_chunks_bound_a_hot_key(sequence):
    for chunks in (16, 200):
        chunked, _ = ordered._chunked(sequence, ["key"], ["t", "id"], chunks)
        largest = chunked.groupBy("key", "__chunk").count().agg(F.max("count")).first()[0]
        assert largest < 2 * sequence.count() / chunks


def test_equal_order_values_are_cut_by_the_tie_key(sequence):
    same = sequence.withColumn("t", F.lit("noon"))
    chunked, _ = ordered._chunked(same, ["key"], ["t", "id"], 16)
    largest = chunked.groupBy("key", "__chunk").count().agg(F.max("count")).first()[0]
    assert largest < 2 * sequence.count() / 16
    whole, cut = ({r["id"]: r["v"] for r in ordered.forward_fill(same, ["key"], ["t", "id"], ["v"], c).collect()} for c in (1, 16))
    assert whole == cut


def test_only_keys_at_the_edge_of_a_chunk_are_summarised(spark):
    many = spark.range(2000).selectExpr("id % 1000 AS key", "id AS t")
    chunked, _ = ordered._chunked(many, ["key"], ["t"], 4)
    assert ordered._spanning(chunked, ["key"]).select("key").distinct().count() <= 8


def test_chunks_follow_the_row_count(sequence, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 100)
    assert ordered._chunked(sequence, ["key"], ["t", "id"], None)[1] == 30


# trial runs

def test_dry_run(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "x int, y int")
    result = dryrun.dry_run(df, lambda d: d.withColumn("z", F.col("x") + F.col("y")))
    assert result.success and (result.input_rows, result.output_rows) == (3, 3)
    assert sorted(r["z"] for r in result.sample_output) == [11, 22, 33]
    again = dryrun.dry_run(df.orderBy(F.desc("x")), lambda d: d.withColumn("z", F.col("x") + F.col("y")))
    assert again.fingerprint == result.fingerprint


def test_dry_run_reports_failures(spark):
    df = spark.createDataFrame([(1, 0)], "x int, y int")
    late = dryrun.dry_run(df, lambda d: d.withColumn("z", F.expr("x / y")))
    assert not late.success and late.errors
    early = dryrun.dry_run(df, lambda d: d.select("missing"))
    assert not early.success and "missing" in early.errors[0]


def test_dry_run_time_limit(spark):
    df = spark.range(3_000_000, numPartitions=8)
    slow = dryrun.dry_run(df, lambda d: d.selectExpr("sha2(repeat(CAST(id AS string), 20000), 512) AS h"), 0.5)
    assert not slow.success and "timed out" in slow.errors[0]


def test_reconcile(spark):
    df = spark.range(10)
    row = dryrun.reconcile(df, df.filter("id < 4")).first()
    assert tuple(row) == (10, 4, -6, 0.4, False)
    assert dryrun.reconcile(df, df.filter("id < 0")).first()["empty_output"] is True


def test_statistics_take_the_type_of_their_column(spark):
    df = spark.createDataFrame([(9007199254740993, 1), (None, 2), (9007199254740995, 4)], "n bigint, k int")
    for fill in (clean.fill_mean, clean.fill_median):
        filled = fill(df, ["n"])
        assert dict(filled.dtypes)["n"] == "bigint"
        assert {9007199254740993, 9007199254740995} <= {r["n"] for r in filled.collect()}


def test_infinities_and_nan_do_not_move_bounds(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(inf,), (-inf,), (nan,), (None,)], "v double")
    kept = [r["v"] for r in clean.remove_outliers(df, "v").collect()]
    assert len(kept) == 102 and inf not in kept and None in kept
    capped = [r["v"] for r in clean.cap_outliers(df, ["v"]).collect() if r["v"] is not None and r["v"] == r["v"]]
    assert len(capped) == 102 and all(abs(v) < 400 for v in capped)


def test_upsert_of_null_keys(spark):
    batch = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    once = clean.upsert(batch.limit(0), batch, ["k"])
    assert sorted((r["k"] or 0, r["v"]) for r in clean.upsert(once, batch, ["k"]).collect()) == [(0, 1), (2, 2)]


def test_codes_lose_nothing(spark):
    df = spark.createDataFrame([("007", "1"), ("12", "n/a"), ("x", "2.5")], "a string, b string")
    lost = {r["column"]: r["lost"] for r in clean.cast_losses(df, {"a": "double", "b": "double"}).collect()}
    assert lost == {"a": 2, "b": 0}


@pytest.mark.parametrize("texts, lost", [
    (["1.1", "1.10", "2.3"], 1), (["9007199254740993"], 1), (["12345678901234567890"], 1), (["1e400"], 1), ([" 12 ", "12"], 1), (["1_000"], 1),
    (["+5", "5"], 1), (["-0", "0"], 1), (["1.0", "1"], 1), (["1e3"], 1), (["12", "1.5", "-3", "0", "0.25", "n/a", "", None], 0), (["12.0", "1.5", "1.0E10"], 0),
    (["123456789012345"], 0), (["Infinity", "2.0"], 0),
])
def test_what_a_cast_changes_is_lost(spark, texts, lost):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert clean.cast_losses(df, {"v": "double"}).first()["lost"] == lost


def test_versions_keep_their_values(spark):
    from tablecare.plans.heal import heal

    df = spark.createDataFrame([(i, ["1.1", "1.10", "2.3", "2.30"][i % 4]) for i in range(200)], "id int, version string")
    counts = {r["version"]: r["count"] for r in heal(df).df.groupBy("version").count().collect()}
    assert counts == {v: 50 for v in ("1.1", "1.10", "2.3", "2.30")}


def test_long_digit_runs_are_numbers(spark):
    df = spark.createDataFrame([("7" * 50_000,), ("1_000",), ("1__0",), ("_1",)], "v string")
    from tablecare.functions.text import is_numeric_text

    assert [r[0] for r in df.select(is_numeric_text("v")).collect()] == [True, True, False, False]
