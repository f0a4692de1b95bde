import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tablecare.operators import profile
from tablecare.operators.profile import (
    distinct_counts, duplicate_rows, head_rows, head_values, profile_columns, profile_table,
)
from tablecare.plans.heal import heal
from tablecare.sources.tables import read_csv


def by_column(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture()
def small_csv(spark, tmp_path):
    path = tmp_path / "small.csv"
    path.write_text(
        "id,city,price,day\n11,Oslo,10.25,2023-05-01\n12,Rome,20.75,2023-05-02\n"
        "13,Oslo,10.25,2023-05-03\n14,,14.00,2023-05-07\n"
    )
    return read_csv(spark, str(path), dates=False)


def test_profile_of_small_csv(small_csv):
    found = by_column(profile_columns(small_csv))
    assert found["id"]["row_count"] == 4
    assert found["city"]["null_count"] == 1 and found["city"]["null_percent"] == 25.0
    assert found["city"]["unique_count"] == 2
    assert found["price"]["semantic_type"] == "float"
    assert found["day"]["semantic_type"] == "datetime_string"
    assert found["day"]["latest"] == dt.datetime(2023, 5, 7)
    prices = [10.25, 20.75, 10.25, 14.0]
    assert found["price"]["mean"] == round(statistics.mean(prices), 2)
    assert found["price"]["std"] == round(statistics.stdev(prices), 2)
    assert found["id"]["duplicate_rows"] == 0
    table = profile_table(small_csv, "small.csv").first()
    assert tuple(table) == ("small.csv", 4, 4, 0)


def test_repeated_rows_count_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [("x", None, 1.0), ("x", None, 1.0), (None, "x", 1.0), (None, "x", float("nan")), (None, "x", None)],
        "a string, b string, c double",
    )
    # ('x', null) and (null, 'x') differ; NaN and null are both missing
    assert duplicate_rows(df).first()[0] == 2
    assert by_column(profile_columns(df))["a"]["duplicate_rows"] == 2


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "v double")
    row = profile_columns(df).first()
    assert (row["null_count"], row["null_percent"], row["unique_count"]) == (2, 50.0, 1)
    assert (row["min"], row["max"], row["mean"], row["std"]) == (1.0, 1.0, 1.0, 0.0)


def test_std_of_one_value_is_null(spark):
    assert profile_columns(spark.createDataFrame([(3,)], "v int")).first()["std"] is None


def test_empty_table(spark):
    row = profile_columns(spark.createDataFrame([], "v string")).first()
    assert (row["row_count"], row["unique_count"], row["duplicate_rows"]) == (0, 0, 0)
    assert row["null_percent"] is None
    # no value contradicts a date
    assert row["semantic_type"] == "datetime_string"
    assert profile_table(spark.createDataFrame([], "v string")).first()["row_count"] == 0


@pytest.mark.parametrize("values, expected", [
    (["2024-01-15", "2024-02-29"], "datetime_string"),
    (["2023-02-29", "2024-01-15"], "string"),
    (["2024-01-15", "15/01/2024"], "string"),
    (["13/01/2024", "01/13/2024"], "string"),
    (["13/01/2024", "01/12/2024"], "datetime_string"),
    (["01/13/2024", "01/12/2024"], "datetime_string"),
    (["2024-01-15T10:00:00Z", "2024-01-15T10:00:00+05:30"], "datetime_string"),
    (["2024-01-15 10:00:00"], "datetime_string"),
    (["2024-01-15 25:00:00"], "string"),
    (["20240115", "20240116"], "string"),
    (["2024"], "string"),
    (["hello"], "string"),
])
def test_text_dates(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert profile_columns(df, {"types"}).first()["semantic_type"] == expected
    sampled = profile_columns(
        df.withColumn("k", F.monotonically_increasing_id()), {"types"}, mode="sample", order_by=["k"]
    )
    assert by_column(sampled)["v"]["semantic_type"] == expected


def test_sample_mode_judges_leading_values_only(spark):
    rows = [(i, "1" if i < 5 else "word", "2024-01-0%d" % (i + 1) if i < 5 else "2025-06-01") for i in range(9)]
    df = spark.createDataFrame(rows, "k int, v string, d string")
    sample = by_column(profile_columns(df, mode="sample", order_by=["k"]))
    full = by_column(profile_columns(df))
    assert sample["v"]["numeric_values"] == 5 and sample["v"]["text_values"] == 5
    assert full["v"]["numeric_values"] == 5 and full["v"]["text_values"] == 9
    assert sample["d"]["latest"] == dt.datetime(2024, 1, 5)
    assert full["d"]["latest"] == dt.datetime(2025, 6, 1)


def test_sample_mode_needs_an_order(spark):
    with pytest.raises(ValueError):
        profile_columns(spark.range(3).toDF("id"), mode="sample")


def test_zone_is_dropped_for_freshness(spark):
    df = spark.createDataFrame([("2024-01-15T23:30:00+05:00",), ("2024-01-15T10:00:00Z",)], "d string")
    assert profile_columns(df).first()["latest"] == dt.datetime(2024, 1, 15, 23, 30)


@pytest.mark.parametrize("text, numeric", [
    ("12", True), (" 12 ", True), ("-1.5e3", True), (".5", True), ("5.", True), ("1_000", True), ("inf", True),
    ("NaN", True), ("-Infinity", True), ("\t7\n", True), ("1d", False), ("1f", False), ("", False), ("n/a", False),
    ("1__0", False), ("_1", False), ("1 2", False), ("infinite", False), ("e5", False), (".", False),
    ("In the end 5", False),
])
def test_numeric_text_follows_a_lenient_float_parser(spark, text, numeric):
    try:
        float(text)
        assert numeric
    except ValueError:
        assert not numeric
    df = spark.createDataFrame([(text,)], "v string")
    assert profile_columns(df, {"types"}).first()["numeric_values"] == int(numeric)


def test_nested_columns_are_profiled_for_nulls_and_repeats(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (map('a', 1), array('x', null)), (map('a', 1), array('x', null)),"
        " (map('a', 2), array('x')), (null, null) AS t(m, l)"
    )
    found = by_column(profile_columns(df))
    assert found["m"]["semantic_type"] == "complex" and found["m"]["null_count"] == 1
    assert found["m"]["unique_count"] is None
    assert found["m"]["duplicate_rows"] == 1


def test_distinct_counts_match_native(spark):
    df = spark.range(5000).selectExpr(
        "id % 7 AS a", "CAST(id % 13 AS string) AS b", "id * 1.5 AS c", "CAST(id AS decimal(30,2)) AS d",
        "id % 2 = 0 AS e", "CAST(null AS string) AS f", "date_add(DATE'2020-01-01', CAST(id % 400 AS int)) AS g",
    )
    native = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first()
    ours = {r["position"]: r["unique_count"] for r in distinct_counts(df).collect()}
    assert [ours.get(i, 0) for i in range(len(df.columns))] == list(native)
    assert ours[-1] == 5000


def test_approximate_mode_counts_near_unique_columns_exactly(spark):
    df = spark.range(20_000).selectExpr("id AS k", "CAST(id AS string) AS unique_text", "id % 10 AS few", "1 AS one")
    found = by_column(profile_columns(df, {"distinct", "duplicates"}, approx=True))
    assert found["k"]["unique_count"] == 20_000 and found["unique_text"]["unique_count"] == 20_000
    assert found["one"]["unique_count"] == 1 and found["few"]["unique_count"] == 10
    assert found["k"]["duplicate_rows"] == 0


def test_approximate_mode_tells_two_values_of_one_register_apart(spark):
    """At this precision the leading 12 bits of a value's hash name its register."""
    same = spark.range(400).groupBy(F.expr("shiftrightunsigned(xxhash64(id), 52)").alias("register")).agg(F.collect_list("id").alias("ids"))
    x, y = same.where("size(ids) > 1").orderBy("register").first()["ids"][:2]
    df = spark.range(1000).selectExpr("id", f"CASE WHEN id % 2 = 0 THEN {x}L ELSE {y}L END AS flag")
    assert df.agg(F.approx_count_distinct("flag", 0.02)).first()[0] == 1
    assert by_column(profile_columns(df, {"distinct"}, approx=True))["flag"]["unique_count"] == 2
    healed = heal(df)
    assert healed.df.columns == ["id", "flag"] and healed.df.select("flag").distinct().count() == 2


def test_many_columns_and_odd_names(spark):
    names = [f"c {i}.`x`" if i % 2 else f"it's-{i}" for i in range(60)]
    df = spark.range(3).select(*[F.col("id").cast("string" if i % 3 else "bigint").alias(n) for i, n in enumerate(names)])
    found = profile_columns(df).orderBy("position").collect()
    assert [r["column"] for r in found] == names
    assert all(r["unique_count"] == 3 for r in found)


def test_heads(spark):
    df = spark.createDataFrame([(3, None), (1, "b"), (2, None), (4, "d")], "k int, v string")
    assert [tuple(r) for r in head_rows(df, ["k"], 2).collect()] == [("1", "b"), ("2", "NULL")]
    values = {(r["column"], r["position"]): r["value"] for r in head_values(df, ["k"], 2).collect()}
    assert values == {("k", 1): "1", ("k", 2): "2", ("v", 1): "b", ("v", 2): "d"}


def test_scan_groups_respect_the_budget(spark):
    schema = spark.createDataFrame([], ", ".join(f"c{i} {'string' if i % 2 else 'int'}" for i in range(20))).schema
    groups = profile._scan_groups(schema, profile.SCAN_BUDGET)
    assert [f.name for g in groups for _, f in g] == schema.names
    assert len(groups) > 1


def test_profile_of_a_hot_value_leaves_no_large_group(spark):
    """Copies collapse before the shuffle: the plan aggregates partially on both sides."""
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS string) END AS v")
    plan = distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(position")
    assert "HashAggregate" in plan[:exchange] and "HashAggregate" in plan[exchange:]


def test_text_columns_are_scanned_apart(spark):
    """The evidence of two text columns is more code than the JVM compiles."""
    schema = spark.createDataFrame([], "a string, b string, c int, d string, e double, f int").schema
    groups = profile._scan_groups(schema, profile.SCAN_BUDGET)
    texts = [[f.name for _, f in g if f.dataType.simpleString() == "string"] for g in groups]
    assert [f.name for g in groups for _, f in g] == schema.names
    assert all(len(t) <= 1 for t in texts) and sum(map(len, texts)) == 3


def test_distinct_keys_of_few_columns_share_a_task(spark):
    """Whole rows and every few columns are counted apart, with the same counts."""
    df = spark.range(2000).selectExpr("id % 1500 AS a", *[f"IF(id % {k} = 1, null, id % {k}) AS c{k}" for k in range(2, 10)], "CAST(null AS string) AS n")
    counts = distinct_counts(df)
    expands = counts._jdf.queryExecution().optimizedPlan().toString().count("Expand")
    assert expands == -(-len(df.columns) // profile.DISTINCT_COLUMNS) + 1
    rows = [tuple(r) for r in df.collect()]
    expected = {i: len({r[i] for r in rows if r[i] is not None}) for i in range(len(df.columns) - 1)}
    assert {r["position"]: r["unique_count"] for r in counts.collect()} == expected | {-1: len(set(rows))}
