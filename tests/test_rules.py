import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecare.operators import drift, rules

SCHEMA = (
    "position int, column string, dtype string, semantic_type string, row_count bigint, null_count bigint,"
    " null_percent double, min double, max double, mean double, std double, text_values bigint,"
    " numeric_values bigint, pii_type string, pii_method string, latest timestamp_ntz, unique_count bigint,"
    " duplicate_rows bigint"
)


def profile_of(spark, *columns, rows=100, duplicates=0):
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]
    base = dict.fromkeys(names) | {
        "dtype": "double", "semantic_type": "float", "row_count": rows, "null_percent": 0.0,
        "unique_count": 50, "duplicate_rows": duplicates,
    }
    data = [tuple((base | {"position": i} | c)[n] for n in names) for i, c in enumerate(columns)]
    return spark.createDataFrame(data, SCHEMA)


def found(df):
    return {(r["rule"], r["column"], r["severity"]) for r in df.collect()}


@pytest.mark.parametrize("percent, severity", [
    (60.0, "critical"), (50.01, "critical"), (50.0, "warning"), (20.01, "warning"), (20.0, "info"),
    (0.01, "info"), (0.0, None),
])
def test_null_thresholds_are_strict(spark, percent, severity):
    got = found(rules.check(profile_of(spark, {"column": "sales", "null_percent": percent})))
    assert got == ({("null_threshold", "sales", severity)} if severity else set())


@pytest.mark.parametrize("duplicates, rows, severity", [
    (15, 100, "critical"), (10, 100, "warning"), (1, 100, "warning"), (1, 100_000, None), (0, 100, None),
])
def test_duplicate_thresholds(spark, duplicates, rows, severity):
    got = found(rules.check(profile_of(spark, {"column": "a"}, {"column": "b"}, rows=rows, duplicates=duplicates)))
    assert got == ({("duplicate_threshold", "_all_", severity)} if severity else set())


@pytest.mark.parametrize("text, numeric, hit", [(5, 3, True), (4, 2, False), (2, 2, False), (3, 2, True)])
def test_type_consistency(spark, text, numeric, hit):
    column = {"column": "c", "semantic_type": "string", "text_values": text, "numeric_values": numeric}
    assert bool(found(rules.check(profile_of(spark, column)))) is hit


def test_cardinality_order(spark):
    def one(semantic, unique, rows):
        return {r for r, _, _ in found(rules.check(
            profile_of(spark, {"column": "c", "semantic_type": semantic, "unique_count": unique}, rows=rows)))}

    assert one("string", 100, 100) == {"high_cardinality"}
    assert one("integer", 100, 100) == set()
    assert one("string", 1, 100) == {"low_cardinality"}
    # a single row: text is unique, an integer is constant
    assert one("string", 1, 1) == {"high_cardinality"}
    assert one("integer", 1, 1) == {"low_cardinality"}


@pytest.mark.parametrize("low, high, mean, std, hit", [
    (-100.0, 100000.0, 50.0, 100.0, True),
    (0.0, 550.0, 50.0, 100.0, False),
    (0.0, 550.01, 50.0, 100.0, True),
    (-450.0, 60.0, 50.0, 100.0, False),
    (-450.01, 60.0, 50.0, 100.0, True),
    (0.0, 9.0, 1.0, 0.0, False),
    (0.0, 9.0, 1.0, None, False),
])
def test_outliers_are_strictly_beyond_five_deviations(spark, low, high, mean, std, hit):
    column = {"column": "x", "min": low, "max": high, "mean": mean, "std": std}
    assert (("outlier_detection", "x", "warning") in found(rules.check(profile_of(spark, column)))) is hit


@pytest.mark.parametrize("name, hit", [
    ("sales_amount", True), ("Discount", True), ("country", True), ("homepage", True), ("balance", False),
])
def test_negative_values_go_by_name(spark, name, hit):
    got = found(rules.check(profile_of(spark, {"column": name, "min": -50.0})))
    assert bool(got) is hit


@pytest.mark.parametrize("latest, hit", [
    (dt.datetime(2024, 1, 1), False), (dt.datetime(2023, 12, 31, 23, 59, 59), False),
    (dt.datetime(2023, 12, 31, 0, 0, 0), True),
])
def test_freshness_counts_whole_days(spark, latest, hit):
    column = {"column": "d", "semantic_type": "datetime", "latest": latest}
    as_of = "2024-12-31 00:00:00"
    got = found(rules.check(profile_of(spark, column), as_of=as_of))
    assert bool(got) is hit
    assert not found(rules.check(profile_of(spark, column)))


def test_scores(spark):
    clean = profile_of(spark, {"column": "id", "semantic_type": "integer", "unique_count": 100})
    dirty = profile_of(
        spark, {"column": "a", "null_percent": 60.0}, {"column": "email", "pii_type": "email"}, duplicates=30
    )
    assert rules.report(rules.check(clean)).first()["quality_score"] == 100
    row = rules.report(rules.check(dirty)).first()
    assert row["quality_score"] == 60
    assert (row["critical_count"], row["warning_count"], row["info_count"]) == (3, 0, 0)
    assert row["pii_detected"] is True and row["pii_columns"] == ["email"]


def test_score_never_falls_below_zero(spark):
    worst = profile_of(spark, *[{"column": f"c{i}", "null_percent": 90.0} for i in range(20)])
    assert rules.report(rules.check(worst)).first()["quality_score"] == 0


def test_report_without_findings(spark):
    row = rules.report(rules.check(profile_of(spark, {"column": "a"}))).first()
    assert tuple(row) == (100, 0, 0, 0, 0, False, [])


def test_texts(spark):
    profile = profile_of(spark, {"column": "o'clock", "null_percent": 60.0, "pii_type": "phone"}, duplicates=15)
    texts = {r["rule"]: (r["description"], r["recommendation"]) for r in rules.check(profile).collect()}
    assert texts["null_threshold"][0] == "Column 'o'clock' has 60.0% null values (>50% threshold)"
    assert texts["duplicate_threshold"][0] == "15 duplicate rows (15.0% of data)"
    assert texts["pii_detected"] == (
        "Potential PII detected in 'o'clock': phone",
        "Apply mask (show last 4 digits only) before storing in data warehouse",
    )


def test_ranking_and_groups(spark):
    findings = rules.check(profile_of(
        spark, {"column": "a", "null_percent": 5.0}, {"column": "b", "null_percent": 60.0},
        {"column": "c", "null_percent": 30.0},
    ))
    assert [r["severity"] for r in rules.ranked(findings).collect()] == ["critical", "warning", "info"]
    grouped = {r["severity"]: r for r in rules.findings_by_severity(findings).collect()}
    assert grouped["critical"]["columns"] == ["b"] and grouped["info"]["findings"] == 1


@pytest.mark.parametrize("score, overall, band", [(70, 82, "warning"), (100, 85, "success"), (59, 80, "error"), (80, 83, "success")])
def test_readiness_and_band(spark, score, overall, band):
    df = spark.createDataFrame([(score,)], "quality_score bigint")
    assert rules.readiness(df).first()["overall"] == overall
    assert df.select(rules.score_band(F.col("quality_score"))).first()[0] == band


def test_drift(spark):
    before = profile_of(spark, {"column": "id", "dtype": "int"}, {"column": "gone", "null_percent": 5.0},
                        {"column": "n", "null_percent": 5.0}, {"column": "m", "null_percent": 10.0})
    after = profile_of(spark, {"column": "id", "dtype": "string"}, {"column": "new", "null_percent": 10.0},
                       {"column": "n", "null_percent": 30.0}, {"column": "m", "null_percent": 30.0})
    issues = drift.drift(after, before)
    assert found(issues) == {
        ("new_column", "new", "warning"), ("removed_column", "gone", "critical"),
        ("type_change", "id", "critical"), ("null_rate_change", "n", "warning"),
    }
    assert {r["points"] for r in issues.collect()} == {8}
    score = rules.report(rules.check(after, previous=before)).first()["quality_score"]
    nulls = rules.report(rules.check(after)).first()["quality_score"]
    assert nulls - score == 32


def test_drift_keys_are_the_full_outer_keys(spark):
    before = profile_of(spark, *[{"column": c} for c in "abc"])
    after = profile_of(spark, *[{"column": c} for c in "bcd"])
    names = lambda df: {r["column"] for r in df.collect()}
    assert names(drift.new_columns(after, before)) == {"d"}
    assert names(drift.removed_columns(after, before)) == {"a"}
    assert names(drift.common_columns(after, before)) == {"b", "c"}
    assert drift.paired(after, before).count() == 4
