"""Quality rules over a profile, and the reports drawn from their findings."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions import pii
from tablecare.functions.text import text_sql

# Thresholds, all compared strictly.
NULL_CRITICAL, NULL_WARNING = 50, 20
DUPLICATES_CRITICAL = 10
NUMERIC_SHARE = 0.5
OUTLIER_SIGMAS = 5
STALE_DAYS = 365

# What one finding takes off the score.
POINTS = {
    ("null_threshold", "critical"): 15,
    ("null_threshold", "warning"): 5,
    ("duplicate_threshold", "critical"): 15,
    ("duplicate_threshold", "warning"): 5,
    ("type_consistency", "warning"): 3,
    ("low_cardinality", "warning"): 3,
    ("outlier_detection", "warning"): 5,
    ("negative_values", "warning"): 5,
    ("pii_detected", "critical"): 10,
}
DRIFT_POINTS = 8

# Description and recommendation of each finding.  {braces} hold
# profile columns, or names the rule fills in.
TEXTS = {
    ("null_threshold", "critical"): (
        "Column '{column}' has {null_percent}% null values (>50% threshold)",
        "Drop column, impute values, or investigate upstream source",
    ),
    ("null_threshold", "warning"): (
        "Column '{column}' has {null_percent}% null values",
        "Consider imputation strategy (mean/median/mode/forward-fill)",
    ),
    ("null_threshold", "info"): (
        "Column '{column}' has {null_percent}% null values",
        "Handle nulls in ETL transformation",
    ),
    ("duplicate_threshold", "critical"): (
        "{duplicate_rows} duplicate rows ({share}% of data)",
        "Implement deduplication with MERGE/UPSERT strategy",
    ),
    ("duplicate_threshold", "warning"): (
        "{duplicate_rows} duplicate rows ({share}%)",
        "Add deduplication step in ETL pipeline",
    ),
    ("type_consistency", "warning"): (
        "Column '{column}' detected as string but contains mostly numeric values",
        "Cast to numeric type in ETL step",
    ),
    ("high_cardinality", "info"): (
        "Column '{column}' has 100% unique values — potential primary key",
        "Consider using as primary key or unique identifier",
    ),
    ("low_cardinality", "warning"): (
        "Column '{column}' has only 1 unique value — zero information content",
        "Consider dropping this column",
    ),
    ("outlier_detection", "warning"): (
        "Column '{column}' has extreme outliers (range: {min}–{max}, mean: {mean}, std: {std})",
        "Add outlier capping/removal in ETL or flag as anomaly",
    ),
    ("negative_values", "warning"): (
        "Column '{column}' has negative values (min={min}) which may be invalid for this field type",
        "Validate negative values — clip to 0 or flag as anomalies",
    ),
    ("pii_detected", "critical"): (
        "Potential PII detected in '{column}': {pii_type}",
        "Apply {remediation} before storing in data warehouse",
    ),
    ("data_freshness", "warning"): (
        "Most recent date in '{column}' is {days} days old",
        "Verify data source is providing current data",
    ),
}

# Name parts of columns that should not be negative.
POSITIVE_NAME_PARTS = ["price", "amount", "quantity", "count", "age", "revenue", "sales"]

# What a profile must measure for each rule to be judged.
MEASURES = {
    "null_threshold": frozenset(),
    "duplicate_threshold": frozenset({"duplicates"}),
    "type_consistency": frozenset({"types"}),
    "high_cardinality": frozenset({"distinct"}),
    "low_cardinality": frozenset({"distinct"}),
    "outlier_detection": frozenset({"stats"}),
    "negative_values": frozenset({"stats"}),
    "pii_detected": frozenset({"pii"}),
    "data_freshness": frozenset({"types", "freshness"}),
}

ALL_COLUMNS = "_all_"

_UNIQUE = "row_count > 0 AND unique_count = row_count AND semantic_type <> 'integer'"

# Readiness of a run that needed no repair.
READINESS_BASE = 75
READINESS_CONSTANTS = {
    "code_quality": 85, "dag_validity": 90, "error_handling": 80, "security": 75, "performance": 80,
}


def finding_sql(category: str, severity: str, rule: str, column: str, texts: tuple[str, str],
                points: int, **names: str) -> str:
    """A finding as a struct.

    `column` is an expression.  Each {name} in the texts stands for the
    expression given for it, or for the profile column of that name.
    """
    description, recommendation = (_filled_sql(text, names) for text in texts)
    return (
        f"struct('{category}' AS category, '{severity}' AS severity, '{rule}' AS rule, {column} AS column,"
        f" {description} AS description, {recommendation} AS recommendation,"
        f" true AS detected, {points}L AS points)"
    )


def _filled_sql(template: str, names: dict[str, str]) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        f"CAST({names.get(piece, piece)} AS string)" if i % 2 else text_sql(piece)
        for i, piece in enumerate(pieces) if piece
    ]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _case(rule: str, *branches: tuple[str, str], category: str = "data_quality",
          column: str = "column", **names: str) -> str:
    """A finding of the severity whose condition holds first, else null."""
    cases = " ".join(
        f"WHEN {condition} THEN " + finding_sql(
            category, severity, rule, column, TEXTS[rule, severity], POINTS.get((rule, severity), 0), **names
        )
        for severity, condition in branches
    )
    return f"CASE {cases} END"


def _rules_sql() -> list[str]:
    """Rules that need nothing but the profile."""
    share = "round(try_divide(duplicate_rows * 100.0D, row_count), 2)"
    reach = f"{OUTLIER_SIGMAS} * std"
    name_parts = "|".join(POSITIVE_NAME_PARTS)
    return [
        _case(
            "null_threshold",
            ("critical", f"null_percent > {NULL_CRITICAL}"),
            ("warning", f"null_percent > {NULL_WARNING}"),
            ("info", "null_percent > 0"),
        ),
        # one finding for the table, made from the row of its first column
        _case(
            "duplicate_threshold",
            ("critical", f"position = 0 AND {share} > {DUPLICATES_CRITICAL}"),
            ("warning", f"position = 0 AND {share} > 0"),
            column=f"'{ALL_COLUMNS}'", share=share,
        ),
        _case(
            "type_consistency",
            ("warning", "semantic_type = 'string' AND text_values > 2"
                        f" AND numeric_values > text_values * {NUMERIC_SHARE}D"),
        ),
        _case("high_cardinality", ("info", _UNIQUE)),
        _case("low_cardinality", ("warning", f"row_count > 0 AND unique_count = 1 AND NOT ({_UNIQUE})")),
        _case(
            "outlier_detection",
            ("warning", f"std > 0 AND (max > mean + {reach} OR min < mean - {reach})"),
        ),
        _case("negative_values", ("warning", f"min < 0 AND lower(column) RLIKE '{name_parts}'")),
        _case(
            "pii_detected", ("critical", "pii_type IS NOT NULL"),
            category="security", remediation=pii.remediation_sql("pii_type"),
        ),
    ]


def _freshness_sql(as_of: datetime | str) -> str:
    moment = f"CAST('{as_of}' AS timestamp_ntz)"
    days = f"floor((unix_micros(CAST({moment} AS timestamp)) - unix_micros(CAST(latest AS timestamp))) / 86400000000L)"
    return _case(
        "data_freshness",
        ("warning", f"semantic_type IN ('datetime', 'datetime_string') AND {days} > {STALE_DAYS}"),
        days=days,
    )


def check(profile: DataFrame, *, as_of: datetime | str | None = None,
          previous: DataFrame | None = None) -> DataFrame:
    """Findings of all rules over a profile, one row each.

    Freshness is judged against `as_of` and left out without it; drift against
    the `previous` profile.  Everything is a projection of the profile, whose
    size the schema bounds.
    """
    rules = _rules_sql()
    if as_of is not None:
        rules.append(_freshness_sql(as_of))
    findings = profile.selectExpr(f"inline(filter(array({', '.join(rules)}), f -> f IS NOT NULL))")
    if previous is not None:
        from tablecare.operators.drift import drift

        findings = findings.unionByName(drift(profile, previous))
    return findings


def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for warning, 2 for info."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def ranked(findings: DataFrame) -> DataFrame:
    """Findings, most severe first."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", "rule", "column"
    )


def quality_score(points_total: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.coalesce(points_total, F.lit(0))).cast("bigint")


def report(findings: DataFrame) -> DataFrame:
    """One row: score, counts by severity and the columns holding personal data."""
    personal = F.col("rule") == "pii_detected"
    return findings.agg(
        quality_score(F.sum("points")).alias("quality_score"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
        F.coalesce(F.bool_or(personal), F.lit(False)).alias("pii_detected"),
        F.array_sort(F.collect_list(F.when(personal, F.col("column")))).alias("pii_columns"),
    )


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Per severity: the number of findings, their columns and texts; bounded by columns times rules."""
    return findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.array_sort(F.collect_list("column")).alias("columns"),
        F.array_sort(F.collect_list("description")).alias("descriptions"),
    )


def readiness(quality_report: DataFrame) -> DataFrame:
    """Readiness scores of a run that needed no repair."""
    score = F.col("quality_score")
    return quality_report.select(
        F.least(F.lit(READINESS_BASE) + F.floor(score / 10), F.lit(100)).cast("bigint").alias("overall"),
        score.alias("data_quality"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in READINESS_CONSTANTS.items()],
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "success").when(score >= 60, "warning").otherwise("error")
