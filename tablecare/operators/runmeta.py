"""Run metadata kept as tables: metrics, events, lineage, checkpoints, watermarks.

Column conventions: points (name, value, ts, labels), events (event_type,
session_id, ts, details), lineage nodes (session_id, seq, type, name,
input_rows, output_rows, row_count), stage events (run_id, stage, status, ts,
...), watermarks (source, value, updated_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.operators.ordered import with_previous

POINT_SCHEMA = "name string, value double, ts timestamp, labels map<string,string>"
EVENT_SCHEMA = "event_type string, session_id string, ts timestamp, details map<string,string>"
LINEAGE_SCHEMA = (
    "session_id string, seq int, type string, name string, input_rows bigint, output_rows bigint, "
    "row_count bigint, ts timestamp, details map<string,string>"
)
STAGE_SCHEMA = (
    "run_id string, stage string, status string, ts timestamp, input_hash string, "
    "output_hash string, error string, metadata map<string,string>"
)
WATERMARK_SCHEMA = "source string, value string, tie string, updated_at timestamp"


# metrics and events

def metric_key(name: Column, labels: Column) -> Column:
    """Name, then ':' and the labels as k=v in key order when there are any."""
    pairs = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])
        ),
        ",",
    )
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(name, F.lit(":"), pairs)).otherwise(name)


def session_metrics(points: DataFrame, session_id: str) -> DataFrame:
    """The points labelled with one session, as rows.

    Points of one name under different label sets all stay.
    """
    return points.filter(F.col("labels")["session_id"] == session_id)


def session_metric_summary(points: DataFrame) -> DataFrame:
    """Per session and metric name: number of points, extremes and sum."""
    return points.groupBy(F.col("labels")["session_id"].alias("session_id"), "name").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.round(F.sum("value"), 4).alias("sum_value"),
    )


def metrics_summary(points: DataFrame, events: DataFrame) -> DataFrame:
    """One row: point and event counts with the sorted names and event types.

    Names and types are reduced per value before they are listed; the lists are
    as long as the vocabulary of the code that records them, not as the data.
    """
    names = points.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_metrics"),
        F.array_sort(F.collect_list("name")).alias("metric_keys"),
    )
    kinds = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_events"),
        F.array_sort(F.collect_list("event_type")).alias("event_types"),
    )
    other = kinds.select(F.struct("total_events", "event_types")).scalar()
    return names.withColumn("__e", other).select(
        "total_metrics", F.col("__e.total_events").alias("total_events"),
        "metric_keys", F.col("__e.event_types").alias("event_types"),
    )


def phase_durations(events: DataFrame, keys: list[str], is_start: Column, is_stop: Column,
                    ts: str = "ts") -> DataFrame:
    """Milliseconds from the first start to the last stop per key; 0 when either is missing."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    started, stopped = F.min(F.when(is_start, micros)), F.max(F.when(is_stop, micros))
    return events.groupBy(*keys).agg(
        F.coalesce(F.floor((stopped - started) / 1000), F.lit(0)).cast("bigint").alias("duration_ms")
    )


def error_counts(events: DataFrame, phase: str, is_error: Column) -> DataFrame:
    """Per phase: events, errors and the error share."""
    return events.groupBy(F.col(phase).alias("phase")).agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count_if(is_error).alias("errors_total"),
        F.round(F.count_if(is_error) / F.count(F.lit(1)), 4).alias("error_rate"),
    )


def event_json_lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each event as one JSON object in column order, null fields left out."""
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


# lineage

def lineage_row_delta(nodes: DataFrame) -> DataFrame:
    """Rows gained or lost by each transformation."""
    return nodes.filter(F.col("type") == "transformation").select(
        "session_id", "seq", "name", (F.col("output_rows") - F.col("input_rows")).alias("row_delta")
    )


def _with_predecessor(nodes: DataFrame) -> DataFrame:
    """Nodes with the number and name of the node before in their session, gaps or not."""
    named = nodes.withColumn("__node", F.struct("seq", "name"))
    return with_previous(named, ["session_id"], ["seq"], "__node", "__before")


def lineage_edges(nodes: DataFrame) -> DataFrame:
    """Edges between successive nodes of a session, in order of their numbers."""
    return _with_predecessor(nodes).where("__before IS NOT NULL").select(
        "session_id", F.col("__before.seq").alias("from_seq"), F.col("seq").alias("to_seq"),
        F.col("__before.name").alias("from_name"), F.col("name").alias("to_name"),
    )


def lineage_lines(nodes: DataFrame) -> DataFrame:
    """Lines of a Mermaid diagram per session as rows, to be read in line_no order."""
    # fixed values: the diagram format's line shapes
    node_id = F.concat(F.lit("N"), F.col("seq").cast("string"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    shape = (
        F.when(F.col("type") == "source", F.format_string('    %s[("%s")]', node_id, F.col("name")))
        .when(F.col("type") == "transformation",
              F.format_string('    %s["%s\\n%s→%s rows"]', node_id, F.col("name"),
                              known("input_rows"), known("output_rows")))
        .when(F.col("type") == "sink",
              F.format_string('    %s[("%s\\n%s rows")]', node_id, F.col("name"), known("row_count")))
    )
    first = F.col("__before").isNull()
    link = F.when(~first, F.format_string("    N%s --> N%s", F.col("__before.seq").cast("string"), F.col("seq").cast("string")))
    head = F.when(first, F.lit("graph LR"))
    lines = _with_predecessor(nodes).select("session_id", "seq", F.posexplode(F.array(head, shape, link)).alias("part", "line"))
    return lines.filter(F.col("line").isNotNull()).select(
        "session_id", (F.col("seq") * 3 + F.col("part")).cast("bigint").alias("line_no"), "line"
    )


def lineage_mermaid(nodes: DataFrame, session_id: str) -> str:
    """Diagram text of one run; its length follows the run's recorded nodes, not its data."""
    lines = lineage_lines(nodes.filter(F.col("session_id") == session_id)).orderBy("line_no")
    return "\n".join(r["line"] for r in lines.toLocalIterator())


# stage checkpoints

def latest_checkpoint(stages: DataFrame, keys: list[str], order_by: list[str],
                      keep: list[str] | None = None) -> DataFrame:
    """Latest state per stage, with the time it was last started.

    `order_by` leads with the event time.  One aggregation with map-side
    combining, so the history of a busy stage is never gathered.
    """
    state = F.struct(*order_by, "status", *(keep or []))
    time = order_by[0]
    started = F.max(F.when(F.col("status") == "started", F.col(time)))
    return (
        stages.groupBy(*keys)
        .agg(F.max(state).alias("__s"), started.alias("started_at"))
        .select(*keys, F.col("__s.status").alias("status"), "started_at",
                F.col(f"__s.{time}").alias("updated_at"), *[F.col(f"__s.{k}").alias(k) for k in keep or []])
    )


def checkpoint_progress(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: stages completed and stages seen."""
    return latest.groupBy(*keys).agg(
        F.count_if(F.col("status") == "completed").alias("completed_count"),
        F.count(F.lit(1)).alias("total_stages"),
    )


def completed_stages(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("status") == "completed")


def unprocessed(inputs: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a completed entry in the ledger."""
    done = ledger.filter(F.col("status") == "completed").select(*keys).distinct()
    return inputs.join(done, keys, "left_anti")


# watermarks

def watermark_by_source(df: DataFrame, source: str, column: str) -> DataFrame:
    """Highest value seen per source."""
    return df.groupBy(F.col(source).alias("source")).agg(F.max(column).alias("value"))


def latest_watermarks(entries: DataFrame) -> DataFrame:
    """Highest value per source, so a mark never moves back.

    Values that are all numbers compare as numbers, all times as times, others
    as text; the tie key, if any, as a number or text likewise.
    """
    def rank(c: str) -> list[Column]:
        number, time = F.col(c).try_cast("double"), F.col(c).try_cast("timestamp")
        same = lambda v: F.when(F.min(v.isNotNull()).over(of), v)
        return [same(number), same(time), F.col(c)]

    of = Window.partitionBy("source")
    ranked = entries.select("source", "value", "tie", "updated_at", F.struct(*rank("value"), *rank("tie"), "updated_at").alias("__r"))
    return ranked.groupBy("source").agg(F.max_by(F.struct("value", "tie", "updated_at"), "__r").alias("m")).select("source", "m.*")


def above_mark(df: DataFrame, column: str, mark, tie: str | None = None, tie_mark=None) -> Column:
    """Whether a row is strictly above a mark, compared in the column's own type."""
    own = F.col(quoted(column))
    value = F.lit(mark).cast(df.schema[column].dataType)
    above = own > value
    if tie is not None:
        key = F.col(quoted(tie))
        later = key.isNotNull() if tie_mark is None else key > F.lit(tie_mark).cast(df.schema[tie].dataType)
        above = above | ((own == value) & later)
    return above


def incremental_since(df: DataFrame, column: str, mark, tie: str | None = None, tie_mark=None) -> DataFrame:
    """Rows strictly above a mark.

    With a tie key, rows at the mark count when their key is above `tie_mark`,
    so rows sharing the boundary time are neither lost nor repeated.  No mark
    means everything.
    """
    return df if mark is None or mark == "" else df.filter(above_mark(df, column, mark, tie, tie_mark))


# windowed quality metrics

def windowed_error_rate(events: DataFrame, ts: str, window: str, keys: list[str], is_error: Column) -> DataFrame:
    """Per tumbling window and keys: events and errors; works on batches and streams."""
    return events.groupBy(F.window(ts, window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events_total"), F.count_if(is_error).alias("errors_total")
    ).select(F.col("w.start").alias("window_start"), *keys, "events_total", "errors_total")
