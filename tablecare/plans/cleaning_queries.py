"""Cleaning, repair, sinks and trial runs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.operators import clean, dryrun, ordered
from tablecare.plans.catalog import query
from tablecare.plans.heal import heal
from tablecare.plans.relations import (
    DIRTY_COLUMNS, DIRTY_FINDINGS_SQL, DIRTY_SQL, NUMERIC_SQL, TABLES, dirty_orders, duplicates_sql,
    findings_sql, profile_sql, table,
)
from tablecare.sources import tables as sources
from tablecare.sources.bucketed import BucketedTable
from tablecare.sources.session import work_path


@query("revenue_by_region", """
SELECT r_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
""")
def revenue_by_region(spark, folder) -> DataFrame:
    return clean.revenue_by_region(*[
        table(spark, folder, n) for n in ("lineitem", "orders", "customer", "nation", "region")
    ])


@query("derived_column", """
SELECT l_orderkey, l_linenumber, l_partkey,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
FROM lineitem
""")
def derived_column(spark, folder) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, folder, "lineitem").withColumn("charge", F.round(charge, 6)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "charge"
    )


# nulls

@query("null_fill_mean", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(mostly_null,
       (SELECT CAST(round(round(avg(mostly_null), 2)) AS BIGINT) FROM dirty_orders)) AS mostly_null
FROM dirty_orders
""")
def null_fill_mean(spark, folder) -> DataFrame:
    return clean.fill_mean(dirty_orders(spark, folder).select("o_orderkey", "mostly_null"), ["mostly_null"])


@query("null_fill_median", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(mostly_null,
       (SELECT CAST(round(quantile_cont(mostly_null, 0.5)) AS BIGINT) FROM dirty_orders)) AS mostly_null
FROM dirty_orders
""")
def null_fill_median(spark, folder) -> DataFrame:
    return clean.fill_median(dirty_orders(spark, folder).select("o_orderkey", "mostly_null"), ["mostly_null"])


def _mode_sql(column: str, relation: str) -> str:
    return (f"(SELECT {column} FROM {relation} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


@query("null_fill_mode", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(some_null, {_mode_sql('some_null', 'dirty_orders')}) AS some_null,
       coalesce(few_null, {_mode_sql('few_null', 'dirty_orders')}) AS few_null
FROM dirty_orders
""")
def null_fill_mode(spark, folder) -> DataFrame:
    df = dirty_orders(spark, folder).select("o_orderkey", "some_null", "few_null")
    return clean.fill_mode(df, ["some_null", "few_null"])


@query("null_fill_constant", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(some_null, 'unknown') AS some_null, coalesce(mostly_null, -1) AS mostly_null
FROM dirty_orders
""")
def null_fill_constant(spark, folder) -> DataFrame:
    df = dirty_orders(spark, folder).select("o_orderkey", "some_null", "mostly_null")
    return clean.fill_constant(df, {"some_null": "unknown", "mostly_null": -1})


@query("null_drop", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, some_null, few_null FROM dirty_orders WHERE some_null IS NOT NULL AND few_null IS NOT NULL
""")
def null_drop(spark, folder) -> DataFrame:
    df = dirty_orders(spark, folder).select("o_orderkey", "some_null", "few_null")
    return clean.drop_null_rows(df, ["some_null", "few_null"])


@query("null_flag", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, some_null, few_null, some_null IS NULL AS some_null_was_null, few_null IS NULL AS few_null_was_null
FROM dirty_orders
""")
def null_flag(spark, folder) -> DataFrame:
    df = dirty_orders(spark, folder).select("o_orderkey", "some_null", "few_null")
    return clean.flag_nulls(df, ["some_null", "few_null"])


@query("ffill_events", """
WITH holes AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM holes
""")
def ffill_events(spark, folder) -> DataFrame:
    holes = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "ts", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value"
    )
    filled = ordered.forward_fill(holes, ["user_id"], ["ts", "event_id"], ["value"])
    return filled.select("event_id", "user_id", "value")


@query("ffill_hot_key", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN -1 ELSE user_id END AS user_id, strftime(ts, '%Y-%m') AS month,
                  CASE WHEN event_id % 4 = 0 THEN value END AS value FROM events)
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY month, event_id) AS value FROM e
""")
def ffill_hot_key(spark, folder) -> DataFrame:
    """Two thirds of the events under one user, thousands of them at one order value, which is text."""
    events = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 < 2 THEN -1 ELSE user_id END AS user_id", "date_format(ts, 'yyyy-MM') AS month",
        "CASE WHEN event_id % 4 = 0 THEN value END AS value",
    )
    return ordered.forward_fill(events, ["user_id"], ["month", "event_id"], ["value"], chunks=8).select("event_id", "value")


# columns

_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate"
_KEPT = f"o_orderkey, some_null, few_null, amount, code, constant_col, {_DATE_SQL}"


def _dated(df: DataFrame) -> DataFrame:
    """The order time as text, alike in both engines."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("drop_sparse_columns", f"WITH {DIRTY_SQL} SELECT {_KEPT} FROM dirty_orders")
def drop_sparse_columns(spark, folder) -> DataFrame:
    return _dated(clean.drop_sparse_columns(dirty_orders(spark, folder)))


@query("drop_constant_columns", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, CAST(mostly_null AS DOUBLE) AS mostly_null, some_null, few_null, amount, code, {_DATE_SQL} FROM dirty_orders
""")
def drop_constant_columns(spark, folder) -> DataFrame:
    kept = _dated(clean.drop_constant_columns(dirty_orders(spark, folder)))
    return kept.withColumn("mostly_null", F.col("mostly_null").cast("double"))


# duplicates

@query("dedup_exact", f"""
WITH {DIRTY_SQL}
SELECT DISTINCT o_orderkey, CAST(mostly_null AS DOUBLE) AS mostly_null, some_null, few_null, amount, code, constant_col, {_DATE_SQL}
FROM dirty_orders
""")
def dedup_exact(spark, folder) -> DataFrame:
    kept = _dated(clean.dedup_exact(dirty_orders(spark, folder)))
    return kept.withColumn("mostly_null", F.col("mostly_null").cast("double"))


@query("dedup_keep_first", """
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def dedup_keep_first(spark, folder) -> DataFrame:
    kept = clean.dedup_keep_first(table(spark, folder, "documents"), ["text"], ["doc_id"])
    return kept.select("doc_id", "lang", "source", "n_chars")


@query("dedup_ignoring_key", f"""
WITH {DIRTY_SQL}
SELECT min(o_orderkey) AS o_orderkey, some_null, few_null, code
FROM dirty_orders GROUP BY some_null, few_null, code
""")
def dedup_ignoring_key(spark, folder) -> DataFrame:
    df = dirty_orders(spark, folder).select("o_orderkey", "some_null", "few_null", "code")
    return clean.dedup_keep_first(df, ["some_null", "few_null", "code"], ["o_orderkey"])


# types

@query("safe_cast", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, CASE WHEN regexp_matches(code, '{NUMERIC_SQL}') THEN TRY_CAST(code AS DOUBLE) END AS code
FROM dirty_orders
""")
def safe_cast(spark, folder) -> DataFrame:
    return clean.safe_cast(dirty_orders(spark, folder).select("o_orderkey", "code"), {"code": "double"})


@query("cast_rejects", f"""
WITH {DIRTY_SQL}
SELECT 'code' AS "column", count(code) AS values,
       count(*) FILTER (WHERE code IS NOT NULL AND TRY_CAST(code AS DOUBLE) IS NULL) AS rejected FROM dirty_orders
UNION ALL
SELECT 'few_null', count(few_null),
       count(*) FILTER (WHERE few_null IS NOT NULL AND TRY_CAST(few_null AS BIGINT) IS NULL) FROM dirty_orders
""")
def cast_rejects(spark, folder) -> DataFrame:
    return clean.cast_rejects(dirty_orders(spark, folder), {"code": "double", "few_null": "bigint"})


# ranges

_BOUNDS_SQL = """
b AS (SELECT avg(value) - 5 * stddev_samp(value) AS low, avg(value) + 5 * stddev_samp(value) AS high FROM events)
"""


@query("outlier_flag_rows", f"""
WITH {_BOUNDS_SQL}
SELECT event_id, value, value < low OR value > high AS value_is_outlier FROM events, b
""")
def outlier_flag_rows(spark, folder) -> DataFrame:
    return clean.flag_outliers(table(spark, folder, "events").select("event_id", "value"), "value")


@query("outlier_cap", f"""
WITH {_BOUNDS_SQL}
SELECT event_id, round(greatest(least(value, high), low), 4) AS value FROM events, b
""")
def outlier_cap(spark, folder) -> DataFrame:
    capped = clean.cap_outliers(table(spark, folder, "events").select("event_id", "value"), ["value"])
    return capped.select("event_id", F.round("value", 4).alias("value"))


@query("outlier_remove", f"""
WITH {_BOUNDS_SQL}
SELECT event_id, value FROM events, b WHERE NOT (value < low OR value > high)
""")
def outlier_remove(spark, folder) -> DataFrame:
    return clean.remove_outliers(table(spark, folder, "events").select("event_id", "value"), "value")


@query("clip_negative", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, CASE WHEN amount < 0 THEN 0.0::DOUBLE ELSE amount END AS amount FROM dirty_orders
""")
def clip_negative(spark, folder) -> DataFrame:
    return clean.clip_negative(dirty_orders(spark, folder).select("o_orderkey", "amount"), ["amount"])


_RAGGED_SQL = """
ragged AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE
                        WHEN event_id % 83 = 0 THEN '-inf'::DOUBLE ELSE value END AS value FROM events),
r AS (SELECT avg(value) - 5 * stddev_samp(value) AS low, avg(value) + 5 * stddev_samp(value) AS high FROM ragged WHERE isfinite(value))
"""


def _ragged(spark, folder) -> DataFrame:
    """Event values with NaN and infinities among them."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 97 = 0 THEN double('NaN') WHEN event_id % 89 = 0 THEN double('Infinity')"
        " WHEN event_id % 83 = 0 THEN double('-Infinity') ELSE value END AS value",
    )


@query("outlier_remove_ragged", f"""
WITH {_RAGGED_SQL}
SELECT event_id, isnan(value) AS missing FROM ragged, r WHERE isnan(value) OR (value >= low AND value <= high)
""")
def outlier_remove_ragged(spark, folder) -> DataFrame:
    """Infinities go, NaN rows stay, and neither moves the bounds."""
    return clean.remove_outliers(_ragged(spark, folder), "value").select("event_id", F.isnan("value").alias("missing"))


@query("outlier_cap_ragged", f"""
WITH {_RAGGED_SQL}
SELECT event_id, CASE WHEN NOT isnan(value) THEN round(greatest(least(value, high), low), 4) END AS value FROM ragged, r
""")
def outlier_cap_ragged(spark, folder) -> DataFrame:
    capped = clean.cap_outliers(_ragged(spark, folder), ["value"])
    return capped.select("event_id", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"))


# validation

@query("assert_constraints", f"""
WITH {DIRTY_SQL}, c AS (
  SELECT 'row_count' AS name, greatest(1 - count(*), 0) AS bad FROM dirty_orders
  UNION ALL SELECT 'key present', count(*) FILTER (WHERE o_orderkey IS NULL) FROM dirty_orders
  UNION ALL SELECT 'status present', count(*) FILTER (WHERE some_null IS NULL) FROM dirty_orders
  UNION ALL SELECT 'amount not negative', count(*) FILTER (WHERE coalesce(amount < 0, true)) FROM dirty_orders)
SELECT name AS "constraint", bad = 0 AS ok, CAST(bad AS BIGINT) AS violating_rows FROM c
""")
def assert_constraints(spark, folder) -> DataFrame:
    return clean.assert_constraints(dirty_orders(spark, folder), {
        "key present": F.col("o_orderkey").isNotNull(),
        "status present": F.col("some_null").isNotNull(),
        "amount not negative": F.col("amount") >= 0,
    }, min_rows=1)


# sinks

@query("upsert_orders", """
WITH batch AS (SELECT l_orderkey * 2 AS order_key, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey),
target AS (SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders)
SELECT * FROM target WHERE order_key NOT IN (SELECT order_key FROM batch) UNION ALL SELECT * FROM batch
""")
def upsert_orders(spark, folder) -> DataFrame:
    target = table(spark, folder, "orders").selectExpr("o_orderkey AS order_key", "o_totalprice AS total")
    batch = (
        table(spark, folder, "lineitem").groupBy("l_orderkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
        .select((F.col("l_orderkey") * 2).alias("order_key"), "total")
    )
    return clean.upsert(target, batch, ["order_key"])


def _versions(spark, folder) -> BucketedTable:
    """Orders in buckets, then a batch of new totals and keys, then some orders deleted."""
    store = BucketedTable(spark, work_path(spark, "bucketed"), ["order_key"], buckets=32)
    orders = table(spark, folder, "orders")
    store.upsert(orders.selectExpr("o_orderkey AS order_key", "o_totalprice AS total", "o_orderstatus AS status"))
    batch = orders.where("o_custkey % 50 = 1").selectExpr("if(o_orderkey % 3 = 0, -o_orderkey, o_orderkey) AS order_key", "if(o_orderkey % 3 = 1, o_totalprice, o_totalprice + 1) AS total", "o_orderstatus AS status")
    store.upsert(batch)
    store.delete(orders.where("o_custkey % 50 = 2").selectExpr("o_orderkey AS order_key"))
    return store


_VERSIONS_SQL = """
old AS (SELECT o_orderkey AS order_key, o_totalprice AS total, o_orderstatus AS status FROM orders),
batch AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS order_key,
                 CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE o_totalprice + 1 END AS total, o_orderstatus AS status FROM orders WHERE o_custkey % 50 = 1),
new AS (SELECT * FROM (SELECT * FROM old WHERE order_key NOT IN (SELECT order_key FROM batch) UNION ALL SELECT * FROM batch)
        WHERE order_key NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 2))
"""


@query("upsert_buckets", f"WITH {_VERSIONS_SQL} SELECT * FROM new")
def upsert_buckets(spark, folder) -> DataFrame:
    return _versions(spark, folder).read()


@query("table_diff", f"""
WITH {_VERSIONS_SQL}
SELECT coalesce(n.order_key, o.order_key) AS order_key, CASE WHEN o.order_key IS NULL THEN 'added' WHEN n.order_key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.order_key = n.order_key
WHERE o.order_key IS NULL OR n.order_key IS NULL OR o.total IS DISTINCT FROM n.total OR o.status IS DISTINCT FROM n.status
""")
def table_diff(spark, folder) -> DataFrame:
    """Keys added, removed and changed from the first to the last version."""
    store = _versions(spark, folder)
    return store.changes(1, store.version())


@query("upsert_null_keys", """
SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS k, max(o_totalprice) AS total FROM orders GROUP BY 1
""")
def upsert_null_keys(spark, folder) -> DataFrame:
    """The same batch twice: the row without a key is there once."""
    batch = table(spark, folder, "orders").selectExpr("CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS k", "o_totalprice AS total")
    target = batch.limit(0)
    for _ in range(2):
        target = clean.upsert(target, batch, ["k"], ["total"])
    return target


@query("sink_row_counts", f"""
WITH counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)})
SELECT * FROM counts UNION ALL SELECT '_total_', CAST(sum(row_count) AS BIGINT) FROM counts
""")
def sink_row_counts(spark, folder) -> DataFrame:
    return sources.sink_row_counts({t: table(spark, folder, t) for t in TABLES})


@query("sink_sample", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def sink_sample(spark, folder) -> DataFrame:
    return sources.sink_sample(table(spark, folder, "nation").orderBy("n_nationkey"))


@query("landing_files", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CASE WHEN event_id % 3 < 2 THEN 'first' ELSE 'second' END AS run_id FROM events
""")
def landing_files(spark, folder) -> DataFrame:
    """Events that arrive as files in two parts, landed by three runs: each row once, from the run that found its file."""
    from tablecare.sources.landing import Landing
    from tablecare.sources.session import work_path

    events = table(spark, folder, "events").select("event_id", "event_type")
    source, landing = work_path(spark, "arrivals"), Landing(spark, work_path(spark, "landing"))
    for run_id, part in (("first", "event_id % 3 < 2"), ("second", "event_id % 3 = 2"), ("third", "false")):
        events.where(part).write.mode("append").option("header", True).csv(source)
        landing.land(source, run_id)
    return landing.rows().select("event_id", "event_type", "run_id")


@query("dry_run_reconcile", """
SELECT (SELECT count(*) FROM orders) AS input_rows, count(*) AS output_rows,
       count(*) - (SELECT count(*) FROM orders) AS row_delta,
       round(count(*) / (SELECT count(*) FROM orders), 4) AS kept_ratio, count(*) = 0 AS empty_output
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000)
""")
def dry_run_reconcile(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return dryrun.reconcile(orders, orders.filter("o_totalprice > 100000").select("o_custkey").distinct())


# repair

_CLEAN = [c for c in DIRTY_COLUMNS if c[0] not in ("mostly_null", "constant_col", "code")]
_CLEAN.insert(4, ("code", "double", "float"))

# Pass one drops, removes repeats, casts, clips and fills; pass two fills what the cast emptied.
_HEALED_SQL = f"""
{DIRTY_FINDINGS_SQL},
unique_rows AS (SELECT DISTINCT * FROM dirty_orders),
once AS (
  SELECT o_orderkey, coalesce(some_null, {_mode_sql('some_null', 'unique_rows')}) AS some_null,
         coalesce(few_null, {_mode_sql('few_null', 'unique_rows')}) AS few_null,
         CASE WHEN amount < 0 THEN 0 ELSE amount END AS amount, TRY_CAST(code AS DOUBLE) AS code, o_orderdate
  FROM unique_rows),
healed AS (
  SELECT o_orderkey, some_null, few_null, amount,
         coalesce(code, (SELECT round(avg(code), 2) FROM once)) AS code, o_orderdate FROM once),
healed_profile AS ({profile_sql('healed', _CLEAN)}),
healed_findings AS ({findings_sql('healed_profile', duplicates_sql('healed'))})
"""


@query("heal_report", f"""
WITH {_HEALED_SQL}
SELECT coalesce(b.rule, a.rule) AS rule, coalesce(b.n, 0) AS findings_before, coalesce(b.p, 0) AS points_before,
       coalesce(a.n, 0) AS findings_after, coalesce(a.p, 0) AS points_after
FROM (SELECT rule, count(*) AS n, CAST(sum(points) AS BIGINT) AS p FROM findings GROUP BY rule) b
FULL JOIN (SELECT rule, count(*) AS n, CAST(sum(points) AS BIGINT) AS p FROM healed_findings GROUP BY rule) a
ON a.rule = b.rule
""")
def heal_report(spark, folder) -> DataFrame:
    return heal(dirty_orders(spark, folder)).report()


@query("heal_rows_sparse_dups", """
SELECT user_id, event_type, count(*) AS n FROM (
  SELECT DISTINCT user_id, event_type, CASE WHEN event_id % 10 = 0 THEN event_id END AS seldom FROM events)
GROUP BY user_id, event_type
""")
def heal_rows_sparse_dups(spark, folder) -> DataFrame:
    """Rows that differ only in a column repair drops are no repeats of each other."""
    events = table(spark, folder, "events").selectExpr(
        "user_id", "event_type", "CASE WHEN event_id % 10 = 0 THEN event_id END AS seldom"
    )
    healed = heal(events).df
    assert "seldom" not in healed.columns
    return healed.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("heal_pii_mixed", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'mail [email] or [phone]' WHEN event_id % 3 = 0 THEN 'card [credit_card] paid'
                      ELSE 'call [phone]' END AS note FROM events
""")
def heal_pii_mixed(spark, folder) -> DataFrame:
    """Texts found personal by their values lose every match of every type, and nothing else."""
    events = table(spark, folder, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 7 = 0 THEN 'mail jane.doe@example.com or 555-123-4567' WHEN event_id % 3 = 0 THEN 'card 4111111111111111 paid'"
        " ELSE 'call 555-123-4567' END AS note",
    )
    return heal(events).df


@query("heal_cast_rejects", """
SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'AB-' || event_id % 9 ELSE lpad(CAST(event_id % 1000 AS VARCHAR), 4, '0') END AS code,
       CASE event_id % 4 WHEN 0 THEN '1.1' WHEN 1 THEN '1.10' WHEN 2 THEN '2.3' ELSE '2.30' END AS version,
       (event_id % 9 + 1) || 'e400' AS exponent,
       CASE WHEN event_id % 2 = 0 THEN ' 12 ' ELSE '12' END AS padded, CASE WHEN event_id % 3 = 0 THEN '1_000' ELSE '1000' END AS joined,
       CASE WHEN event_id % 6 = 0 THEN '+5' ELSE '5' END AS signed, CAST(event_id % 11 AS DOUBLE) / 4 AS kept
FROM events
""")
def heal_cast_rejects(spark, folder) -> DataFrame:
    """Texts that a cast would lose, change or make equal stay text; numbers that come back from it are cast."""
    events = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 5 < 2 THEN concat('AB-', event_id % 9) ELSE lpad(CAST(event_id % 1000 AS string), 4, '0') END AS code",
        "element_at(array('1.1', '1.10', '2.3', '2.30'), CAST(event_id % 4 AS int) + 1) AS version",
        "concat(event_id % 9 + 1, 'e400') AS exponent",
        "if(event_id % 2 = 0, ' 12 ', '12') AS padded", "if(event_id % 3 = 0, '1_000', '1000') AS joined",
        "if(event_id % 6 = 0, '+5', '5') AS signed", "CAST(CAST(event_id % 11 AS double) / 4 AS string) AS kept",
    )
    return heal(events, exclude=("high_cardinality",)).df


@query("heal_steps", f"""
WITH {_HEALED_SQL}
SELECT 0 AS iteration, (SELECT count(*) FROM dirty_orders) AS row_count, CAST((SELECT greatest(0, 100 - sum(points)) FROM findings) AS INTEGER) AS quality_score
UNION ALL SELECT 2, (SELECT count(*) FROM healed), CAST((SELECT greatest(0, 100 - coalesce(sum(points), 0)) FROM healed_findings) AS INTEGER)
""")
def heal_steps(spark, folder) -> DataFrame:
    """Rows and score before the first and after the last pass."""
    return heal(dirty_orders(spark, folder)).steps.where("iteration <> 1").select("iteration", "row_count", "quality_score")


@query("heal_scores", f"""
WITH {_HEALED_SQL}
SELECT (SELECT greatest(0, 100 - CAST(coalesce(sum(points), 0) AS BIGINT)) FROM findings) AS score_before,
       (SELECT greatest(0, 100 - CAST(coalesce(sum(points), 0) AS BIGINT)) FROM healed_findings) AS score_after
""")
def heal_scores(spark, folder) -> DataFrame:
    return heal(dirty_orders(spark, folder)).scores()


@query("heal_rows", f"""
WITH {_HEALED_SQL}
SELECT o_orderkey, some_null, few_null, amount, code, {_DATE_SQL} FROM healed
""")
def heal_rows(spark, folder) -> DataFrame:
    return _dated(heal(dirty_orders(spark, folder)).df)


_FIX_SQL = """
CASE WHEN rule = 'low_cardinality' OR (rule = 'null_threshold' AND severity = 'critical') THEN 'drop_column'
     WHEN rule = 'duplicate_threshold' THEN 'dedup_exact' WHEN rule = 'type_consistency' THEN 'safe_cast'
     WHEN rule = 'negative_values' THEN 'clip_negative' WHEN rule = 'null_threshold' THEN 'fill_mode' END
"""


@query("heal_history", f"""
WITH {_HEALED_SQL}, once_profile AS ({profile_sql('once', _CLEAN)})
SELECT 1 AS iteration, rule, "column", {_FIX_SQL} AS fix FROM findings
UNION ALL
SELECT 2, 'null_threshold', "column", 'fill_mean' FROM once_profile WHERE null_percent > 0
""")
def heal_history(spark, folder) -> DataFrame:
    return heal(dirty_orders(spark, folder)).history.select("iteration", "rule", "column", "fix")


@query("heal_changes", f"""
WITH {_HEALED_SQL}
SELECT 1 AS iteration, o_orderkey, 'mostly_null' AS "column", CAST(mostly_null AS VARCHAR) AS old, 'drop_column' AS fix, 0 AS copies
FROM unique_rows WHERE mostly_null IS NOT NULL
UNION ALL SELECT 1, o_orderkey, 'constant_col', constant_col, 'drop_column', 0 FROM unique_rows
UNION ALL SELECT 1, o_orderkey, 'some_null', NULL, 'fill_mode', 0 FROM unique_rows WHERE some_null IS NULL
UNION ALL SELECT 1, o_orderkey, 'few_null', NULL, 'fill_mode', 0 FROM unique_rows WHERE few_null IS NULL
UNION ALL SELECT 1, o_orderkey, 'amount', CAST(amount AS VARCHAR), 'clip_negative', 0 FROM unique_rows WHERE amount < 0
UNION ALL SELECT 1, o_orderkey, 'code', code, 'safe_cast', 0 FROM unique_rows
UNION ALL SELECT 1, o_orderkey, '_all_', NULL, 'dedup_exact', count(*) - 1 FROM dirty_orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 2, o_orderkey, 'code', NULL, 'fill_mean', 0 FROM once WHERE code IS NULL
""")
def heal_changes(spark, folder) -> DataFrame:
    """Every cell that repair changed, with its value before, and every repeat it removed."""
    found = heal(dirty_orders(spark, folder), log_keys=["o_orderkey"]).changes()
    return found.select("iteration", "key.o_orderkey", "column", "old", "fix", "copies")


@query("heal_undo", f"""
WITH {DIRTY_SQL} SELECT o_orderkey, mostly_null, some_null, few_null, amount, code, constant_col, {_DATE_SQL} FROM dirty_orders
""")
def heal_undo(spark, folder) -> DataFrame:
    """The table as it came, from the repaired one and the log of its changes."""
    return _dated(heal(dirty_orders(spark, folder), log_keys=["o_orderkey"]).undo())


@query("quality_run", f"""
WITH {_HEALED_SQL}
SELECT 0 AS seq, 'source' AS type, 0 AS input_rows, 0 AS output_rows, count(*) AS row_count FROM dirty_orders
UNION ALL SELECT 1, 'transformation', (SELECT count(*) FROM dirty_orders), count(*), 0 FROM healed
UNION ALL SELECT 2, 'sink', 0, 0, count(*) FROM healed
""")
def quality_run(spark, folder) -> DataFrame:
    from tablecare.plans.run import run
    from tablecare.sources.session import work_path
    from tablecare.sources.store import RunStore

    store = RunStore(spark, work_path(spark, "metadata"))
    run(dirty_orders(spark, folder), work_path(spark, "healed"), store, name="dirty_orders")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("input_rows", "output_rows", "row_count")]
    return store.table("lineage").select("seq", "type", *counts)
