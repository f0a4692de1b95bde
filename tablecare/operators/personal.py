"""Personal data in tables: where it is and how to treat it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions import pii
from tablecare.functions.hashing import quoted
from tablecare.functions.text import pattern_sql
from tablecare.operators.profile import profile_columns


def detect_pii(df: DataFrame, *, mode: str = "full", order_by: list[str] | None = None,
               scan_all_types: bool = False) -> DataFrame:
    """Columns holding personal data: column, type, detection_method, remediation.

    A column name decides first; otherwise the values do.
    """
    profile = profile_columns(
        df, {"pii"}, mode=mode, order_by=order_by, scan_all_types=scan_all_types
    )
    return profile.filter(F.col("pii_type").isNotNull()).select(
        "column",
        F.col("pii_type").alias("type"),
        F.col("pii_method").alias("detection_method"),
        pii.remediation("pii_type").alias("remediation"),
    )


def named_pii(df: DataFrame) -> DataFrame:
    """Columns whose names announce personal data, with the values they expose."""
    profile = profile_columns(df, set())
    kind = pii.type_of_name("column")
    return profile.select(
        "column", kind.alias("type"), (F.col("row_count") - F.col("null_count")).alias("values_exposed")
    ).filter(F.col("type").isNotNull())


def pii_matches(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every match of every type in a text column, as rows (id, kind, value).

    Texts are searched in place and only matches travel on; a pattern's matches
    are listed only where a first one is found.
    """
    c = quoted(text)
    lists = ", ".join(
        f"struct('{kind}' AS kind, CASE WHEN {pii.matches_sql(c, kind)}"
        f" THEN regexp_extract_all({c}, {pattern_sql(pattern)}, 0) END AS found)"
        for kind, pattern in pii.SPANS.items()
    )
    return (
        df.selectExpr(f"{quoted(key)} AS id", f"inline(array({lists}))")
        .selectExpr("id", "kind", "explode(found) AS value")
    )


def remedy_columns(df: DataFrame, types: dict[str, str], salt: str = "") -> DataFrame:
    """Table with each named column treated as its type of personal data advises."""
    return df.select(*[
        pii.remedied(F.col(quoted(c)), types[c], salt).alias(c) if c in types else F.col(quoted(c))
        for c in df.columns
    ])
