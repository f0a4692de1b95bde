"""Profiling, rules and drift over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators import drift, partial, profile, quantile, rules
from tablecare.plans.catalog import query
from tablecare.plans.relations import (
    DIRTY_COLUMNS, DIRTY_FINDINGS_SQL, DIRTY_SQL, LATER_SQL, dirty_orders, duplicates_sql,
    faulty_orders, orders_as_delivered_later, profile_sql, spread_table, table,
)
from tablecare.sources.session import work_path

FINDING = ["rule", "column", "severity", "points"]
AS_OF = "2026-01-01 00:00:00"


# profile

@query("profile_table", f"""
WITH {DIRTY_SQL}
SELECT 'dirty_orders' AS file_name, (SELECT count(*) FROM dirty_orders) AS row_count,
       CAST(8 AS BIGINT) AS column_count, {duplicates_sql('dirty_orders')} AS duplicate_rows
""")
def profile_table(spark, folder) -> DataFrame:
    return profile.profile_table(dirty_orders(spark, folder), "dirty_orders")


@query("profile_columns", f"""
WITH {DIRTY_SQL}, profile AS ({profile_sql('dirty_orders', DIRTY_COLUMNS)})
SELECT position, "column", dtype, semantic_type, row_count, null_count, null_percent, unique_count,
       round(min, 2) AS min, round(max, 2) AS max, mean, std
FROM profile
""")
def profile_columns(spark, folder) -> DataFrame:
    found = profile.profile_columns(dirty_orders(spark, folder), {"stats", "types", "distinct"})
    return found.select(
        "position", "column", "dtype", "semantic_type", "row_count", "null_count", "null_percent",
        "unique_count", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), "mean", "std",
    )


_LINEITEM = [
    ("l_orderkey", "bigint", "integer"), ("l_partkey", "bigint", "integer"), ("l_suppkey", "bigint", "integer"),
    ("l_linenumber", "int", "integer"), ("l_quantity", "double", "float"),
    ("l_extendedprice", "double", "float"), ("l_discount", "double", "float"), ("l_tax", "double", "float"),
    ("l_returnflag", "string", "string"), ("l_linestatus", "string", "string"),
    ("l_shipdate", "timestamp_ntz", "datetime"),
]


@query("profile_lineitem", f"""
WITH profile AS ({profile_sql('lineitem', _LINEITEM)})
SELECT "column", dtype, semantic_type, row_count, null_count, unique_count, mean, std,
       {duplicates_sql('lineitem')} AS duplicate_rows
FROM profile
""")
def profile_lineitem(spark, folder) -> DataFrame:
    found = profile.profile_columns(spread_table(spark, folder, "lineitem"), materialize=True)
    return found.select("column", "dtype", "semantic_type", "row_count", "null_count", "unique_count",
                        "mean", "std", "duplicate_rows")


_NUMBERS = [c for c, _, kind in _LINEITEM if kind in ("integer", "float")]
_SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@query("quantiles_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS share, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS value FROM lineitem"
    for c in _NUMBERS for q in _SHARES
))
def quantiles_lineitem(spark, folder) -> DataFrame:
    """Exact quantiles of all numeric columns, narrowed together."""
    found = quantile.exact_quantiles(spread_table(spark, folder, "lineitem"), {c: _SHARES for c in _NUMBERS})
    rows = [(c, q, round(v, 6)) for c, values in found.items() for q, v in zip(_SHARES, values, strict=True)]
    return spark.createDataFrame(rows, "column string, share double, value double")


@query("profile_numeric", f"""
WITH profile AS ({profile_sql('lineitem', [c for c in _LINEITEM if c[2] == 'float'])})
SELECT "column", min, max, mean, std FROM profile
""")
def profile_numeric(spark, folder) -> DataFrame:
    numbers = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile.profile_columns(numbers, {"stats"}).select("column", "min", "max", "mean", "std")


_EVENTS = [
    ("event_id", "bigint", "integer"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "integer"),
    ("event_type", "string", "string"), ("value", "double", "float"), ("props", "string", "string"),
]


def _events_by_day(spark, folder) -> partial.PartProfiles:
    """States of the days' events, stored in two runs: the second finds later days and more rows of the last day before."""
    path, store = work_path(spark, "events-by-day"), partial.PartProfiles(spark, work_path(spark, "states"))
    events = spread_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    later = F.col("event_id") > events.agg(F.avg("event_id")).scalar()
    for part in (~later, later):
        events.where(part).write.mode("append").partitionBy("day").parquet(path)
        store.add(path, "day")
    return store


@query("profile_by_parts", f"""
WITH profile AS ({profile_sql('events', _EVENTS)})
SELECT position, "column", dtype, semantic_type, row_count, null_count, null_percent, min, max, mean, std FROM profile
""")
def profile_by_parts(spark, folder) -> DataFrame:
    return _events_by_day(spark, folder).profile().select(
        "position", "column", "dtype", "semantic_type", "row_count", "null_count", "null_percent", "min", "max", "mean", "std"
    )


@query("profile_parts_rows", "SELECT strftime(ts, '%Y-%m-%d') AS part, count(*) AS row_count FROM events GROUP BY 1")
def profile_parts_rows(spark, folder) -> DataFrame:
    return _events_by_day(spark, folder).parts()


@query("profile_parts_distinct", f"""
WITH profile AS ({profile_sql('events', _EVENTS)})
SELECT "column", unique_count AS exact, true AS within FROM profile
""")
def profile_parts_distinct(spark, folder) -> DataFrame:
    """Exact distinct counts, and whether the merged sketches are within five standard errors of them."""
    exact = profile.distinct_counts(spread_table(spark, folder, "events"), rows=False).withColumnRenamed("unique_count", "exact")
    within = F.abs(F.col("unique_count") - F.col("exact")) <= 5 * partial.SKETCH_ERROR * F.col("exact")
    return _events_by_day(spark, folder).profile().join(exact, "position").select("column", "exact", within.alias("within"))


@query("duplicate_rows", f"WITH {DIRTY_SQL} SELECT {duplicates_sql('dirty_orders')} AS duplicate_rows")
def duplicate_rows(spark, folder) -> DataFrame:
    return profile.duplicate_rows(dirty_orders(spark, folder))


_DATE_TEXTS = """
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_date, strftime(o_orderdate, '%d/%m/%Y') AS day_first,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso_time,
         CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS mixed,
         CASE WHEN o_orderkey % 1000 = 999 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mostly_date,
         CAST(NULL AS VARCHAR) AS empty, o_totalprice, o_totalprice > 1000 AS large, o_orderdate, o_orderstatus
  FROM orders
"""


def _judged(column: str, regex: str, fmt: str) -> str:
    return (f"count(*) FILTER (WHERE regexp_full_match({column}, '{regex}') "
            f"AND try_strptime({column}, '{fmt}') IS NOT NULL) = count({column})")


def _text_semantic(column: str) -> str:
    fits = " OR ".join([
        _judged(column, r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
        _judged(column, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", "%Y-%m-%dT%H:%M:%SZ"),
        _judged(column, r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"),
    ])
    return (f"SELECT '{column}' AS \"column\", CASE WHEN {fits} THEN 'datetime_string' ELSE 'string' END "
            f"AS semantic_type, count({column}) AS non_null FROM texts")


@query("semantic_types", f"""
WITH texts AS ({_DATE_TEXTS})
{" UNION ALL ".join(_text_semantic(c) for c in ["iso_date", "day_first", "iso_time", "mixed", "mostly_date", "empty", "o_orderstatus"])}
UNION ALL SELECT 'o_orderkey', 'integer', count(o_orderkey) FROM texts
UNION ALL SELECT 'o_totalprice', 'float', count(o_totalprice) FROM texts
UNION ALL SELECT 'large', 'boolean', count(large) FROM texts
UNION ALL SELECT 'o_orderdate', 'datetime', count(o_orderdate) FROM texts
""")
def semantic_types(spark, folder) -> DataFrame:
    texts = spread_table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS iso_date",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS day_first",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS iso_time",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')"
        " ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS mixed",
        "CASE WHEN o_orderkey % 1000 = 999 THEN 'later' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS mostly_date",
        "CAST(null AS string) AS empty", "o_totalprice", "o_totalprice > 1000 AS large", "o_orderdate",
        "o_orderstatus",
    )
    return profile.profile_columns(texts, {"types"}).select(
        "column", "semantic_type", (F.col("row_count") - F.col("null_count")).alias("non_null")
    )


@query("sample_rows", f"""
WITH {DIRTY_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(CAST(mostly_null AS VARCHAR), 'NULL') AS mostly_null,
       coalesce(some_null, 'NULL') AS some_null, coalesce(few_null, 'NULL') AS few_null
FROM (SELECT * FROM base ORDER BY o_orderkey LIMIT 5)
""")
def sample_rows(spark, folder) -> DataFrame:
    orders = faulty_orders(spark, folder).select("o_orderkey", "mostly_null", "some_null", "few_null")
    return profile.head_rows(orders, ["o_orderkey"])


def _first_values(column: str) -> str:
    return (f"SELECT '{column}' AS \"column\", row_number() OVER (ORDER BY o_orderkey) AS position, value FROM "
            f"(SELECT o_orderkey, CAST({column} AS VARCHAR) AS value FROM base WHERE {column} IS NOT NULL "
            f"ORDER BY o_orderkey LIMIT 5)")


@query("sample_values", f"""
WITH {DIRTY_SQL}
{" UNION ALL ".join(_first_values(c) for c in ["o_orderkey", "mostly_null", "some_null", "few_null", "code"])}
""")
def sample_values(spark, folder) -> DataFrame:
    return profile.head_values(
        faulty_orders(spark, folder), ["o_orderkey"],
        columns=["o_orderkey", "mostly_null", "some_null", "few_null", "code"],
    )


# rules

def _findings(spark, folder, measures) -> DataFrame:
    return rules.check(profile.profile_columns(dirty_orders(spark, folder), measures))


_RULES = {
    "rule_null_threshold": "null_threshold",
    "rule_duplicates": "duplicate_threshold",
    "rule_type_consistency": "type_consistency",
    "rule_low_cardinality": "low_cardinality",
    "rule_negative_values": "negative_values",
}


def _register_rule(name: str, rule: str) -> None:
    @query(name, f"WITH {DIRTY_FINDINGS_SQL} SELECT rule, \"column\", severity, CAST(points AS BIGINT) AS points "
                 f"FROM findings WHERE rule = '{rule}'")
    def run(spark, folder) -> DataFrame:
        found = _findings(spark, folder, rules.MEASURES[rule])
        return found.filter(F.col("rule") == rule).select(*FINDING)


for _name, _rule in _RULES.items():
    _register_rule(_name, _rule)


@query("rule_high_cardinality", """
SELECT t AS table_name, c AS "column", 'info' AS severity FROM (
  SELECT 'documents' AS t, 'text' AS c, count(DISTINCT text) = count(*) AS u FROM documents
  UNION ALL SELECT 'documents', 'lang', count(DISTINCT lang) = count(*) FROM documents
  UNION ALL SELECT 'documents', 'source', count(DISTINCT source) = count(*) FROM documents
  UNION ALL SELECT 'pages', 'url', count(DISTINCT url) = count(*) FROM pages
  UNION ALL SELECT 'pages', 'html', count(DISTINCT html) = count(*) FROM pages
  UNION ALL SELECT 'customer', 'c_name', count(DISTINCT c_name) = count(*) FROM customer
  UNION ALL SELECT 'customer', 'c_acctbal', count(DISTINCT c_acctbal) = count(*) FROM customer
  UNION ALL SELECT 'customer', 'c_mktsegment', count(DISTINCT c_mktsegment) = count(*) FROM customer
  UNION ALL SELECT 'events', 'ts', count(DISTINCT ts) = count(*) FROM events
  UNION ALL SELECT 'events', 'event_type', count(DISTINCT event_type) = count(*) FROM events
  UNION ALL SELECT 'events', 'value', count(DISTINCT value) = count(*) FROM events
  UNION ALL SELECT 'events', 'props', count(DISTINCT props) = count(*) FROM events
) WHERE u
""")
def rule_high_cardinality(spark, folder) -> DataFrame:
    parts = [
        rules.check(profile.profile_columns(table(spark, folder, name), {"distinct"}))
        .filter("rule = 'high_cardinality'")
        .select(F.lit(name).alias("table_name"), "column", "severity")
        for name in ("documents", "pages", "customer", "events")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("rule_outliers", """
SELECT 'outlier_detection' AS rule, 'value' AS "column", 'warning' AS severity, CAST(5 AS BIGINT) AS points
FROM (SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 2) AS m, round(stddev_samp(value), 2) AS s FROM events)
WHERE s > 0 AND (hi > m + 5 * s OR lo < m - 5 * s)
""")
def rule_outliers(spark, folder) -> DataFrame:
    found = rules.check(profile.profile_columns(table(spark, folder, "events"), {"stats"}))
    return found.filter("rule = 'outlier_detection'").select(*FINDING)


_DAYS = "CAST(floor((epoch(TIMESTAMP '2026-01-01') - epoch(m)) / 86400) AS BIGINT)"


@query("rule_freshness", f"""
WITH latest AS (
  SELECT 'orders' AS table_name, 'o_orderdate' AS "column", max(o_orderdate) AS m FROM orders
  UNION ALL SELECT 'orders', 'date_text', max(date_trunc('day', o_orderdate)) FROM orders
  UNION ALL SELECT 'events', 'ts', max(ts) FROM events)
SELECT table_name, "column", 'warning' AS severity,
       'Most recent date in ''' || "column" || ''' is ' || {_DAYS} || ' days old' AS description
FROM latest WHERE {_DAYS} > 365
""")
def rule_freshness(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "date_format(o_orderdate, 'yyyy-MM-dd') AS date_text"
    )
    parts = [
        rules.check(profile.profile_columns(df, {"types", "freshness"}), as_of=AS_OF)
        .filter("rule = 'data_freshness'")
        .select(F.lit(name).alias("table_name"), "column", "severity", "description")
        for name, df in (("orders", orders), ("events", table(spark, folder, "events")))
    ]
    return parts[0].unionAll(parts[1])


_SCORE = "CAST(greatest(0, 100 - coalesce(sum(points), 0)) AS BIGINT)"
_REPORT_SQL = f"""
  SELECT {_SCORE} AS quality_score, count(*) AS total_checks,
         count(*) FILTER (WHERE severity = 'critical') AS critical_count,
         count(*) FILTER (WHERE severity = 'warning') AS warning_count,
         count(*) FILTER (WHERE severity = 'info') AS info_count,
         false AS pii_detected, '' AS pii_columns
  FROM findings
"""


@query("quality_score", f"WITH {DIRTY_FINDINGS_SQL} SELECT {_SCORE} AS quality_score FROM findings")
def quality_score(spark, folder) -> DataFrame:
    return rules.report(_findings(spark, folder, profile.ALL_MEASURES)).select("quality_score")


@query("quality_report", f"WITH {DIRTY_FINDINGS_SQL} {_REPORT_SQL}")
def quality_report(spark, folder) -> DataFrame:
    found = rules.report(_findings(spark, folder, profile.ALL_MEASURES))
    return found.withColumn("pii_columns", F.array_join("pii_columns", ","))


@query("findings_by_severity", f"""
WITH {DIRTY_FINDINGS_SQL}
SELECT severity, count(*) AS findings, string_agg("column", ',' ORDER BY "column") AS columns
FROM findings GROUP BY severity
""")
def findings_by_severity(spark, folder) -> DataFrame:
    # the texts differ between engines in how they print numbers, the columns do not
    found = _findings(spark, folder, profile.ALL_MEASURES)
    return rules.findings_by_severity(found).select(
        "severity", "findings", F.array_join("columns", ",").alias("columns")
    )


@query("findings_ranked", f"""
WITH {DIRTY_FINDINGS_SQL}
SELECT rule, "column", severity, CAST(points AS BIGINT) AS points,
       CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank
FROM findings ORDER BY severity_rank, rule, "column"
""")
def findings_ranked(spark, folder) -> DataFrame:
    return rules.ranked(_findings(spark, folder, profile.ALL_MEASURES)).select(*FINDING, "severity_rank")


@query("readiness", f"""
WITH {DIRTY_FINDINGS_SQL}, report AS ({_REPORT_SQL})
SELECT CAST(least(75 + quality_score // 10, 100) AS BIGINT) AS overall, quality_score AS data_quality,
       CAST(85 AS BIGINT) AS code_quality, CAST(90 AS BIGINT) AS dag_validity, CAST(80 AS BIGINT) AS error_handling,
       CAST(75 AS BIGINT) AS security, CAST(80 AS BIGINT) AS performance
FROM report
""")
def readiness(spark, folder) -> DataFrame:
    return rules.readiness(rules.report(_findings(spark, folder, profile.ALL_MEASURES)))


@query("score_band", f"""
WITH {DIRTY_FINDINGS_SQL}, report AS ({_REPORT_SQL})
SELECT quality_score, CASE WHEN quality_score >= 80 THEN 'success' WHEN quality_score >= 60 THEN 'warning'
       ELSE 'error' END AS band FROM report
""")
def score_band(spark, folder) -> DataFrame:
    found = rules.report(_findings(spark, folder, profile.ALL_MEASURES))
    return found.select("quality_score", rules.score_band(F.col("quality_score")).alias("band"))


# drift

_ORDERS = [
    ("o_orderkey", "bigint", "integer"), ("o_custkey", "bigint", "integer"), ("o_orderstatus", "string", "string"),
    ("o_totalprice", "double", "float"), ("o_orderdate", "timestamp_ntz", "datetime"),
    ("o_orderpriority", "string", "string"),
]
_LATER = [
    ("o_orderkey", "bigint", "integer"), ("customer_id", "bigint", "integer"), ("o_totalprice", "string", "string"),
    ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "string"),
]
_PAIR_SQL = (
    f"WITH {LATER_SQL}, prev AS ({profile_sql('orders', _ORDERS)}), cur AS ({profile_sql('later', _LATER)})"
)


def _pair(spark, folder, measures=frozenset()) -> tuple[DataFrame, DataFrame]:
    return (
        profile.profile_columns(orders_as_delivered_later(spark, folder), measures),
        profile.profile_columns(table(spark, folder, "orders"), measures),
    )


_DRIFT_SQL = """
SELECT 'new_column' AS rule, cur."column", 'warning' AS severity, CAST(8 AS BIGINT) AS points
FROM cur WHERE cur."column" NOT IN (SELECT "column" FROM prev)
UNION ALL SELECT 'removed_column', prev."column", 'critical', 8 FROM prev WHERE prev."column" NOT IN (SELECT "column" FROM cur)
UNION ALL SELECT 'type_change', cur."column", 'critical', 8 FROM cur JOIN prev USING ("column") WHERE cur.dtype <> prev.dtype
UNION ALL SELECT 'null_rate_change', cur."column", 'warning', 8 FROM cur JOIN prev USING ("column")
WHERE abs(cur.null_percent - prev.null_percent) > 20
"""


@query("schema_drift", f"{_PAIR_SQL} {_DRIFT_SQL}")
def schema_drift(spark, folder) -> DataFrame:
    return drift.drift(*_pair(spark, folder)).select(*FINDING)


_SHOWN = ["column", "dtype", "row_count", "null_percent", "unique_count"]
_SHOWN_SQL = '"column", dtype, row_count, null_percent, unique_count'


@query("drift_new_columns", f"""{_PAIR_SQL} SELECT {_SHOWN_SQL} FROM cur
WHERE "column" NOT IN (SELECT "column" FROM prev)""")
def drift_new_columns(spark, folder) -> DataFrame:
    return drift.new_columns(*_pair(spark, folder, {"distinct"})).select(*_SHOWN)


@query("drift_removed_columns", f"""{_PAIR_SQL} SELECT {_SHOWN_SQL} FROM prev
WHERE "column" NOT IN (SELECT "column" FROM cur)""")
def drift_removed_columns(spark, folder) -> DataFrame:
    return drift.removed_columns(*_pair(spark, folder, {"distinct"})).select(*_SHOWN)


@query("drift_common_columns", f"""{_PAIR_SQL} SELECT {_SHOWN_SQL} FROM cur
WHERE "column" IN (SELECT "column" FROM prev)""")
def drift_common_columns(spark, folder) -> DataFrame:
    return drift.common_columns(*_pair(spark, folder, {"distinct"})).select(*_SHOWN)


ORDERS_CONTRACT = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_comment", T.StringType()),
])


@query("contract_check", f"""
WITH {LATER_SQL}, cur AS ({profile_sql('later', _LATER)}),
prev("column", dtype) AS (VALUES ('o_orderkey', 'bigint'), ('customer_id', 'string'), ('o_totalprice', 'double'),
                                 ('o_orderdate', 'timestamp_ntz'), ('o_comment', 'string'))
SELECT CASE WHEN prev."column" IS NULL THEN 'new_column' WHEN cur."column" IS NULL THEN 'removed_column'
            ELSE 'type_change' END AS rule,
       coalesce(cur."column", prev."column") AS "column",
       CASE WHEN prev."column" IS NULL THEN 'warning' ELSE 'critical' END AS severity,
       cur.null_percent
FROM cur FULL JOIN prev ON cur."column" = prev."column"
WHERE prev."column" IS NULL OR cur."column" IS NULL OR cur.dtype <> prev.dtype
""")
def contract_check(spark, folder) -> DataFrame:
    found = drift.contract_check(orders_as_delivered_later(spark, folder), ORDERS_CONTRACT)
    return found.select("rule", "column", "severity", "null_percent")
