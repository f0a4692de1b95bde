"""Schema drift between two profiles of a table, and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators.profile import profile_columns
from tablecare.operators.rules import DRIFT_POINTS, finding_sql

# Fixed value: change of the null share, in points, that counts as drift (strictly more).
NULL_SHIFT = 20

# Severity of each drift rule.
SEVERITIES = {
    "new_column": "warning",
    "removed_column": "critical",
    "type_change": "critical",
    "null_rate_change": "warning",
}

# Description and recommendation of each finding.
TEXTS = {
    "new_column": (
        "New column '{name}' detected (not in previous schema)",
        "Update pipeline to handle new column or ignore it",
    ),
    "removed_column": (
        "Column '{name}' was removed from the data source",
        "Update pipeline — downstream dependencies may break",
    ),
    "type_change": (
        "Column '{name}' type changed: {prev_dtype} → {cur_dtype}",
        "Update type casting in ETL pipeline",
    ),
    "null_rate_change": (
        "Column '{name}' null rate changed significantly: {before}% → {after}%",
        "Investigate upstream data source for quality regression",
    ),
}

_SIDE = ["column", "dtype", "null_percent"]


def paired(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both profiles side by side; a side is null where the column is absent."""
    cur = current.select(*[F.col(c).alias(f"cur_{c}") for c in _SIDE])
    prev = previous.select(*[F.col(c).alias(f"prev_{c}") for c in _SIDE])
    return cur.join(prev, F.col("cur_column") == F.col("prev_column"), "full_outer")


def _issues_sql(compare_nulls: bool) -> str:
    """Array of the findings for one pair of columns."""
    both = "cur_column IS NOT NULL AND prev_column IS NOT NULL"
    before, after = "coalesce(prev_null_percent, 0D)", "coalesce(cur_null_percent, 0D)"
    conditions = {
        "new_column": "prev_column IS NULL",
        "removed_column": "cur_column IS NULL",
        "type_change": f"{both} AND NOT cur_dtype <=> prev_dtype",
    }
    if compare_nulls:
        conditions["null_rate_change"] = f"{both} AND abs({after} - {before}) > {NULL_SHIFT}"
    name = "coalesce(cur_column, prev_column)"

    def finding(rule: str) -> str:
        return finding_sql("schema_drift", SEVERITIES[rule], rule, name, TEXTS[rule], DRIFT_POINTS,
                           name=name, before=before, after=after)

    cases = ", ".join(f"CASE WHEN {condition} THEN {finding(rule)} END" for rule, condition in conditions.items())
    return f"filter(array({cases}), f -> f IS NOT NULL)"


def drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings for new, removed, re-typed columns and shifted null shares."""
    return paired(current, previous).selectExpr(f"inline({_issues_sql(compare_nulls=True)})")


def new_columns(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("column"), "column", "left_anti")


def removed_columns(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("column"), "column", "left_anti")


def common_columns(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("column"), "column", "left_semi")


def contract_profile(spark, contract: T.StructType) -> DataFrame:
    """A declared schema in profile form, so drift can compare a table with it."""
    rows = [(f.name, f.dataType.simpleString(), None) for f in contract.fields]
    return spark.createDataFrame(rows, "column string, dtype string, null_percent double")


def contract_check(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Where a table departs from its declared schema, with the null share of its columns.

    A contract declares names and types, so null shares are shown, not compared.
    """
    pair = paired(profile_columns(df, set()), contract_profile(df.sparkSession, contract))
    return pair.selectExpr(
        f"inline({_issues_sql(compare_nulls=False)})", "cur_null_percent AS null_percent"
    )
