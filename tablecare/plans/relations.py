"""Input relations of the registered queries, with their SQL twins.

The given tables hold no nulls and no equal rows, so faults are put in by rules
both engines evaluate alike.  Every relation covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.sources.tables import spread_out

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table about to be searched value by value."""
    return spread_out(table(spark, folder, name))


def faulty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls, negatives, text numbers and a constant."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_custkey END AS mostly_null",
        "CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderstatus END AS some_null",
        "CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_orderpriority END AS few_null",
        "CASE WHEN o_orderkey % 50 = 7 THEN -o_totalprice ELSE o_totalprice END AS amount",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS string) END AS code",
        "'X' AS constant_col",
        "o_orderdate",
    )


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty orders with every eighth key a second time; the table is read once."""
    copies = F.when(F.col("o_orderkey") % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return faulty_orders(spark, folder).select("*", F.explode(copies).alias("__copy")).drop("__copy")


DIRTY_SQL = """
base AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_custkey END AS mostly_null,
         CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderstatus END AS some_null,
         CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_orderpriority END AS few_null,
         CASE WHEN o_orderkey % 50 = 7 THEN -o_totalprice ELSE o_totalprice END AS amount,
         CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS code,
         'X' AS constant_col, o_orderdate
  FROM orders),
dirty_orders AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 8 = 0)
"""

# (name, Spark type, semantic type) of the columns above, in order
DIRTY_COLUMNS = [
    ("o_orderkey", "bigint", "integer"),
    ("mostly_null", "bigint", "integer"),
    ("some_null", "string", "string"),
    ("few_null", "string", "string"),
    ("amount", "double", "float"),
    ("code", "string", "string"),
    ("constant_col", "string", "string"),
    ("o_orderdate", "timestamp_ntz", "datetime"),
]

# A number as text, as both engines' patterns spell it.
NUMERIC_SQL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def profile_sql(relation: str, columns: list[tuple[str, str, str]]) -> str:
    """SELECT of one row per column with the measures of a profile."""
    parts = []
    for i, (name, dtype, semantic) in enumerate(columns):
        numeric = semantic in ("integer", "float")
        stats = (
            f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, "
            f"round(avg(CAST({name} AS DOUBLE)), 2) AS mean, round(stddev_samp(CAST({name} AS DOUBLE)), 2) AS std"
            if numeric else
            "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
            "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"
        )
        text = semantic == "string"
        numbers = (
            f"count(*) FILTER (WHERE regexp_matches({name}, '{NUMERIC_SQL}'))" if text else "CAST(NULL AS BIGINT)"
        )
        parts.append(
            f"SELECT {i} AS position, '{name}' AS \"column\", '{dtype}' AS dtype, "
            f"'{semantic}' AS semantic_type, count(*) AS row_count, "
            f"count(*) - count({name}) AS null_count, "
            f"round(100.0 * (count(*) - count({name})) / count(*), 2) AS null_percent, "
            f"count(DISTINCT {name}) AS unique_count, {stats}, "
            f"{f'count({name})' if text else 'CAST(NULL AS BIGINT)'} AS text_values, {numbers} AS numeric_values "
            f"FROM {relation}"
        )
    return " UNION ALL ".join(parts)


def duplicates_sql(relation: str) -> str:
    return f"(SELECT count(*) FROM {relation}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {relation}))"


_NAME_PARTS = "price|amount|quantity|count|age|revenue|sales"


def findings_sql(profile: str, duplicates: str) -> str:
    """SELECT of (rule, column, severity, points) over a relation shaped like profile_sql."""
    return f"""
SELECT 'null_threshold' AS rule, "column",
       CASE WHEN null_percent > 50 THEN 'critical' WHEN null_percent > 20 THEN 'warning' ELSE 'info' END AS severity,
       CASE WHEN null_percent > 50 THEN 15 WHEN null_percent > 20 THEN 5 ELSE 0 END AS points
FROM {profile} WHERE null_percent > 0
UNION ALL
SELECT 'duplicate_threshold', '_all_', CASE WHEN share > 10 THEN 'critical' ELSE 'warning' END,
       CASE WHEN share > 10 THEN 15 ELSE 5 END
FROM (SELECT round(100.0 * ({duplicates}) / max(row_count), 2) AS share FROM {profile}) WHERE share > 0
UNION ALL
SELECT 'type_consistency', "column", 'warning', 3
FROM {profile} WHERE semantic_type = 'string' AND text_values > 2 AND numeric_values > 0.5 * text_values
UNION ALL
SELECT 'high_cardinality', "column", 'info', 0
FROM {profile} WHERE row_count > 0 AND unique_count = row_count AND semantic_type <> 'integer'
UNION ALL
SELECT 'low_cardinality', "column", 'warning', 3
FROM {profile} WHERE row_count > 0 AND unique_count = 1 AND NOT (unique_count = row_count AND semantic_type <> 'integer')
UNION ALL
SELECT 'outlier_detection', "column", 'warning', 5
FROM {profile} WHERE std > 0 AND (max > mean + 5 * std OR min < mean - 5 * std)
UNION ALL
SELECT 'negative_values', "column", 'warning', 5
FROM {profile} WHERE min < 0 AND regexp_matches(lower("column"), '{_NAME_PARTS}')
"""


DIRTY_FINDINGS_SQL = (
    f"{DIRTY_SQL}, profile AS ({profile_sql('dirty_orders', DIRTY_COLUMNS)}), "
    f"findings AS ({findings_sql('profile', duplicates_sql('dirty_orders'))})"
)


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with contact columns whose names announce personal data."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "c_name AS full_name",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
        "concat('555-', lpad(CAST(c_custkey % 1000 AS string), 3, '0'), '-',"
        " lpad(CAST(c_custkey % 10000 AS string), 4, '0')) AS phone",
        "concat('4000-1234-5678-', lpad(CAST(c_custkey % 10000 AS string), 4, '0')) AS card_number",
        "CAST(date_add(DATE'1950-01-01', CAST(c_custkey % 20000 AS int)) AS string) AS dob",
        "concat('10.0.', CAST(c_custkey % 250 AS string), '.', CAST(c_custkey % 200 AS string)) AS last_login_from",
        "c_mktsegment AS address",
    )


CONTACTS_SQL = """
contacts AS (
  SELECT c_custkey, c_name AS full_name,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         '555-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
         '4000-1234-5678-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS card_number,
         strftime(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER), '%Y-%m-%d') AS dob,
         '10.0.' || (c_custkey % 250) || '.' || (c_custkey % 200) AS last_login_from,
         c_mktsegment AS address
  FROM customer)
"""


def orders_as_delivered_later(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a renamed, a re-typed, a dropped and a partly emptied column."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "o_custkey AS customer_id",
        "CAST(o_totalprice AS string) AS o_totalprice",
        "o_orderdate",
        "CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    )


LATER_SQL = """
later AS (
  SELECT o_orderkey, o_custkey AS customer_id, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)
"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as metric points labelled with their session and a kind."""
    return table(spark, folder, "events").selectExpr(
        "event_type AS name", "value", "ts",
        "map('session_id', CAST(user_id AS string), 'kind', concat('k', CAST(event_id % 3 AS string))) AS labels",
    )


def lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lifecycle events of sessions."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "event_type", "CAST(user_id AS string) AS session_id", "ts",
    )


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stage changes: runs are users, stages come from the props."""
    return table(spark, folder, "events").selectExpr(
        "user_id AS run_id",
        "concat('stage_', CAST(CAST(get_json_object(props, '$.k') AS bigint) % 4 AS string)) AS stage",
        "CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status",
        "ts", "event_id",
    )


STAGES_SQL = """
stages AS (
  SELECT user_id AS run_id, 'stage_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS stage,
         CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
         ts, event_id
  FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) AS rn,
         max(ts) FILTER (WHERE status = 'started') OVER (PARTITION BY run_id, stage) AS started_at
  FROM stages),
latest AS (SELECT * FROM ranked WHERE rn = 1)
"""


def lineage_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lineage nodes: each user is a session, numbered in event order."""
    from tablecare.operators.ordered import with_position

    events = table(spark, folder, "events").selectExpr(
        "CAST(user_id AS string) AS session_id", "ts", "event_id",
        "CASE event_type WHEN 'signup' THEN 'source' WHEN 'purchase' THEN 'sink' ELSE 'transformation' END AS type",
        "concat(event_type, '_', CAST(event_id AS string)) AS name",
        "CAST(get_json_object(props, '$.k') AS bigint) AS input_rows",
        "CAST(floor(value) AS bigint) AS output_rows",
        "CAST(floor(value) AS bigint) AS row_count",
    )
    return with_position(events, ["session_id"], ["ts", "event_id"], "seq")


NODES_SQL = """
nodes AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CASE event_type WHEN 'signup' THEN 'source' WHEN 'purchase' THEN 'sink' ELSE 'transformation' END AS type,
         event_type || '_' || event_id AS name,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_rows,
         CAST(floor(value) AS BIGINT) AS output_rows,
         CAST(floor(value) AS BIGINT) AS row_count
  FROM events)
"""
