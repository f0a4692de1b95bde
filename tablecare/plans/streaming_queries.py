"""Streaming jobs run to the end of what is there, and what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.plans.catalog import query
from tablecare.plans.relations import table
from tablecare.sources.session import work_path
from tablecare.streaming import jobs


def _events(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return jobs.file_stream(spark, folder, schema, glob="events.parquet")


_TS = "'%Y-%m-%d %H:%M:%S.%f'"


@query("stream_incremental", f"SELECT event_id, strftime(ts, {_TS}) AS ts, user_id, event_type, value, props FROM events")
def stream_incremental(spark, folder) -> DataFrame:
    """Two runs of the incremental copy: the second finds nothing new."""
    target, checkpoint = work_path(spark, "stream"), work_path(spark, "offsets")
    for _ in range(2):
        jobs.append_new(_events(spark, folder), target, checkpoint)
    return spark.read.parquet(target).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


#: Files of a part, written by as many tasks and taken as a batch.
_FILES = 4


def _in_files(spark, folder, copies: int = 2) -> DataFrame:
    """All events, each in so many of three parts whose times run backwards; a part is a batch of several files."""
    path = work_path(spark, "arriving")
    events = table(spark, folder, "events")
    for part in (2, 0, 1):
        late = events.where(F.pmod(F.col("event_id") - part, F.lit(3)) < copies)
        late.repartitionByRange(_FILES, F.desc("ts")).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, events.schema, files_per_batch=_FILES)


@query("stream_dedup", f"SELECT event_id, strftime(ts, {_TS}) AS ts, user_id, event_type, value, props FROM events")
def stream_dedup(spark, folder) -> DataFrame:
    """Every event delivered twice, over several batches and out of order, comes out once."""
    target = work_path(spark, "stream")
    jobs.drop_repeats(_in_files(spark, folder), ["event_id"], target, work_path(spark, "offsets"))
    found = spark.read.parquet(target).drop("batch_id")
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("stream_quality_batches", """
SELECT 'outlier_detection' AS rule, 'value' AS "column", 'warning' AS severity, CAST(5 AS BIGINT) AS points
FROM (SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 2) AS m, round(stddev_samp(value), 2) AS s FROM events)
WHERE s > 0 AND (hi > m + 5 * s OR lo < m - 5 * s)
UNION ALL SELECT 'high_cardinality', 'ts', 'info', 0 FROM events HAVING count(DISTINCT ts) = count(*)
UNION ALL SELECT 'high_cardinality', 'value', 'info', 0 FROM events HAVING count(DISTINCT value) = count(*)
UNION ALL SELECT 'data_freshness', 'ts', 'warning', 0 FROM events HAVING max(ts) < TIMESTAMP '2024-12-31'
""")
def stream_quality_batches(spark, folder) -> DataFrame:
    target = work_path(spark, "findings")
    jobs.quality_batches(_events(spark, folder), target, work_path(spark, "offsets"), as_of="2026-01-01")
    return spark.read.parquet(target).select("rule", "column", "severity", "points")


@query("stream_hourly_errors", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events_total,
       count(*) FILTER (WHERE event_type = 'error') AS errors_total
FROM events GROUP BY date_trunc('hour', ts)
""")
def stream_hourly_errors(spark, folder) -> DataFrame:
    """All windows, the last one too."""
    target = work_path(spark, "stream")
    jobs.windowed_errors(
        _in_files(spark, folder, 1), "ts", "1 hour", "10 minutes", [], F.col("event_type") == "error", target, work_path(spark, "offsets")
    )
    return jobs.latest_windows(spark, target, []).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_window_quality", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events_total, count(*) FILTER (WHERE value < 20) AS errors_total,
       round(100.0 * count(*) FILTER (WHERE event_id % 7 = 0) / count(*), 2) AS props_null_percent,
       round(100.0 * count(*) FILTER (WHERE user_id % 5 = 0) / count(*), 2) AS user_id_null_percent
FROM events GROUP BY 1, 2
""")
def stream_window_quality(spark, folder) -> DataFrame:
    """Errors and nulls per day and type from parts that come out of order, added up in between."""
    target, checkpoint = work_path(spark, "stream"), work_path(spark, "offsets")
    holed = _in_files(spark, folder, 1).withColumn("props", F.when(F.col("event_id") % 7 != 0, F.col("props"))).withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    jobs.windowed_errors(holed, "ts", "1 day", "10 minutes", ["event_type"], F.col("value") < 20, target, checkpoint, ["props", "user_id"])
    jobs.compact_windows(spark, target)
    found = jobs.latest_windows(spark, target, ["event_type"], ["props", "user_id"])
    return found.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
