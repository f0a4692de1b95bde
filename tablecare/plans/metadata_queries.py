"""Run metadata over the events: metrics, lineage, checkpoints, watermarks, JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import row_fingerprint
from tablecare.functions.json_text import salvage_fields
from tablecare.operators import ordered, runmeta
from tablecare.plans.catalog import query
from tablecare.plans.relations import (
    NODES_SQL, STAGES_SQL, lifecycle, lineage_nodes, points, spread_table, stage_events, table,
)
from tablecare.sources.session import work_path
from tablecare.sources.store import RunStore

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_TIME_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def _time(name: str):
    return F.date_format(name, _TIME).alias(name)


# metrics and events

@query("metric_key", """
SELECT event_type || ':kind=k' || (event_id % 3) || ',session_id=' || user_id AS metric_key,
       count(*) AS points, round(max(value), 2) AS max_value
FROM events GROUP BY 1
""")
def metric_key(spark, folder) -> DataFrame:
    return points(spark, folder).groupBy(
        runmeta.metric_key(F.col("name"), F.col("labels")).alias("metric_key")
    ).agg(F.count(F.lit(1)).alias("points"), F.round(F.max("value"), 2).alias("max_value"))


@query("session_metrics", """
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS name, count(*) AS points,
       min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum_value
FROM events GROUP BY user_id, event_type
""")
def session_metrics(spark, folder) -> DataFrame:
    return runmeta.session_metric_summary(points(spark, folder))


@query("metrics_summary", """
SELECT count(*) AS total_metrics, count(*) AS total_events,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS metric_keys,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types
FROM events
""")
def metrics_summary(spark, folder) -> DataFrame:
    found = runmeta.metrics_summary(points(spark, folder), lifecycle(spark, folder))
    return found.select(
        "total_metrics", "total_events",
        F.array_join("metric_keys", ",").alias("metric_keys"),
        F.array_join("event_types", ",").alias("event_types"),
    )


@query("phase_durations", """
SELECT CAST(user_id AS VARCHAR) AS session_id,
       coalesce(CAST(floor((epoch_us(max(ts) FILTER (WHERE event_type = 'purchase'))
                          - epoch_us(min(ts) FILTER (WHERE event_type = 'view'))) / 1000) AS BIGINT), 0) AS duration_ms
FROM events GROUP BY user_id
""")
def phase_durations(spark, folder) -> DataFrame:
    return runmeta.phase_durations(
        lifecycle(spark, folder), ["session_id"],
        F.col("event_type") == "view", F.col("event_type") == "purchase",
    )


@query("error_rate_by_type", """
SELECT 'k' || (event_id % 3) AS phase, count(*) AS events_total,
       count(*) FILTER (WHERE event_type = 'error') AS errors_total,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate
FROM events GROUP BY 1
""")
def error_rate_by_type(spark, folder) -> DataFrame:
    events = points(spark, folder).withColumn("kind", F.col("labels")["kind"])
    return runmeta.error_counts(events, "kind", F.col("name") == "error")


@query("hourly_error_rate", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events_total,
       count(*) FILTER (WHERE event_type = 'error') AS errors_total
FROM events GROUP BY 1
""")
def hourly_error_rate(spark, folder) -> DataFrame:
    found = runmeta.windowed_error_rate(
        table(spark, folder, "events"), "ts", "1 hour", [], F.col("event_type") == "error"
    )
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("event_json_lines", """
SELECT '{"session_id":"' || user_id || '","event_type":"' || event_type || '"'
       || CASE WHEN event_type = 'error' THEN ',"error_type":"E' || (event_id % 3) || '"' ELSE '' END
       || ',"row_count":' || event_id || '}' AS value
FROM events
""")
def event_json_lines(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").selectExpr(
        "CAST(user_id AS string) AS session_id", "event_type",
        "CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id % 3 AS string)) END AS error_type",
        "event_id AS row_count",
    )
    return runmeta.event_json_lines(events, ["session_id", "event_type", "error_type", "row_count"])


# lineage

@query("lineage_row_delta", f"""
WITH {NODES_SQL}
SELECT session_id, seq, name, output_rows - input_rows AS row_delta FROM nodes WHERE type = 'transformation'
""")
def lineage_row_delta(spark, folder) -> DataFrame:
    return runmeta.lineage_row_delta(lineage_nodes(spark, folder))


@query("lineage_edges", f"""
WITH {NODES_SQL}, e AS (
  SELECT session_id, seq - 1 AS from_seq, seq AS to_seq,
         lag(name) OVER (PARTITION BY session_id ORDER BY seq) AS from_name, name AS to_name FROM nodes)
SELECT * FROM e WHERE to_seq > 0
""")
def lineage_edges(spark, folder) -> DataFrame:
    return runmeta.lineage_edges(lineage_nodes(spark, folder))


@query("lineage_edges_gaps", f"""
WITH {NODES_SQL}, e AS (
  SELECT session_id, lag(seq) OVER w AS from_seq, seq AS to_seq, lag(name) OVER w AS from_name, name AS to_name
  FROM nodes WHERE seq % 3 <> 1 WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT * FROM e WHERE from_seq IS NOT NULL
""")
def lineage_edges_gaps(spark, folder) -> DataFrame:
    """Edges lead over numbers that are missing."""
    return runmeta.lineage_edges(lineage_nodes(spark, folder).where("seq % 3 <> 1"))


@query("lineage_predecessors", f"""
SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM events
""")
def lineage_predecessors(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    found = ordered.with_previous(events, ["user_id"], ["ts", "event_id"], "event_type", "previous_type")
    return found.select("event_id", "previous_type")


@query("lineage_diagram", f"""
WITH {NODES_SQL}
SELECT session_id, CAST(0 AS BIGINT) AS line_no, 'graph LR' AS line FROM nodes WHERE seq = 0
UNION ALL
SELECT session_id, seq * 3 + 1, CASE type
         WHEN 'source' THEN '    N' || seq || '[("' || name || '")]'
         WHEN 'transformation' THEN '    N' || seq || '["' || name || '\\n' || input_rows || '→' || output_rows || ' rows"]'
         ELSE '    N' || seq || '[("' || name || '\\n' || row_count || ' rows")]' END FROM nodes
UNION ALL
SELECT session_id, seq * 3 + 2, '    N' || (seq - 1) || ' --> N' || seq FROM nodes WHERE seq > 0
""")
def lineage_diagram(spark, folder) -> DataFrame:
    return runmeta.lineage_lines(lineage_nodes(spark, folder))


# checkpoints

_LATEST = ["run_id", "stage", "status"]


def _latest(spark, folder) -> DataFrame:
    return runmeta.latest_checkpoint(stage_events(spark, folder), ["run_id", "stage"], ["ts", "event_id"])


@query("latest_checkpoint", f"""
WITH {STAGES_SQL}
SELECT run_id, stage, status, strftime(started_at, {_TIME_SQL}) AS started_at,
       strftime(ts, {_TIME_SQL}) AS updated_at FROM latest
""")
def latest_checkpoint(spark, folder) -> DataFrame:
    return _latest(spark, folder).select(*_LATEST, _time("started_at"), _time("updated_at"))


@query("checkpoint_progress", f"""
WITH {STAGES_SQL}
SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS completed_count, count(*) AS total_stages
FROM latest GROUP BY run_id
""")
def checkpoint_progress(spark, folder) -> DataFrame:
    return runmeta.checkpoint_progress(_latest(spark, folder), ["run_id"])


@query("stage_completed", f"WITH {STAGES_SQL} SELECT run_id, stage FROM latest WHERE status = 'completed'")
def stage_completed(spark, folder) -> DataFrame:
    return runmeta.completed_stages(_latest(spark, folder)).select("run_id", "stage")


@query("unprocessed_inputs", """
SELECT o_orderkey AS input_key, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
""")
def unprocessed_inputs(spark, folder) -> DataFrame:
    inputs = table(spark, folder, "orders").selectExpr("o_orderkey AS input_key", "o_custkey")
    ledger = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS input_key", "CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'started' END AS status"
    )
    return runmeta.unprocessed(inputs, ledger, ["input_key"])


@query("row_fingerprint", """
SELECT o_orderkey, substring(sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2)),
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)), 1, 16) AS fingerprint
FROM orders
""")
def row_fingerprint_query(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    plain = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return plain.select("o_orderkey", row_fingerprint(orders.columns, separator="|").alias("fingerprint"))


# watermarks

@query("watermark_by_source", f"""
SELECT event_type AS source, strftime(max(ts), {_TIME_SQL}) AS value FROM events GROUP BY event_type
""")
def watermark_by_source(spark, folder) -> DataFrame:
    return runmeta.watermark_by_source(table(spark, folder, "events"), "event_type", "ts").select(
        "source", _time("value")
    )


@query("incremental_since", """
SELECT event_id, event_type FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15')
""")
def incremental_since(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    mark = events.filter("event_type = 'signup' AND ts < TIMESTAMP_NTZ'2024-01-15'").agg(F.max("ts")).first()[0]
    return runmeta.incremental_since(events, "ts", mark).select("event_id", "event_type")


@query("incremental_twice", "SELECT event_id, event_type FROM events")
def incremental_twice(spark, folder) -> DataFrame:
    """Two reads with a stored mark, half the events arriving between them: together every event once."""
    store, parts = RunStore(spark, work_path(spark, "metadata")), []
    events = table(spark, folder, "events")
    first = events.where(F.col("ts") < events.agg(F.median(F.unix_micros(F.col("ts").cast("timestamp"))).alias("m")).select(F.timestamp_micros(F.col("m").cast("long"))).scalar())
    for seen in (first, events):
        fresh, mark = store.read_since(seen, "events", "ts", tie="event_id")
        parts.append(fresh)
        store.set_watermark("events", mark)
    return parts[0].unionByName(parts[1]).select("event_id", "event_type")


# JSON text

@query("json_field_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_field_props(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "props")
    return salvage_fields(events, "props", ["k"]).selectExpr("event_id", "CAST(k AS bigint) AS k")


@query("json_field_salvage", """
SELECT event_id, event_id % 5 AS form, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS reasoning
FROM events
""")
def json_field_salvage(spark, folder) -> DataFrame:
    """Props as plain, fenced, wrapped, unclosed and run-on responses; all give the field back."""
    good = "concat('{\"k\": \"', get_json_object(props, '$.k'), '\", \"reasoning\": \"', event_type, '\"}')"
    raw = spread_table(spark, folder, "events").selectExpr(
        "event_id", "event_id % 5 AS form",
        f"""CASE event_id % 5
              WHEN 0 THEN {good}
              WHEN 1 THEN concat('```json\\n', {good}, '\\n```')
              WHEN 2 THEN concat('Here it is: ', {good}, ' Done.')
              WHEN 3 THEN concat('```json\\n', left({good}, length({good}) - 1))
              ELSE concat('{{bad ', substring({good}, 2)) END AS raw""",
    )
    return salvage_fields(raw, "raw", ["k", "reasoning"]).selectExpr(
        "event_id", "form", "CAST(k AS bigint) AS k", "reasoning"
    )
