"""Trial runs of user transforms and row reconciliation."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import table_fingerprint

SAMPLE_ROWS = 5


@dataclass
class DryRun:
    """Outcome of a trial run."""

    success: bool = False
    errors: list[str] = field(default_factory=list)
    input_rows: int = 0
    output_rows: int = 0
    execution_time_ms: float = 0.0
    fingerprint: str = ""
    sample_output: list[dict] = field(default_factory=list)


def dry_run(df: DataFrame, transform: Callable[[DataFrame], DataFrame],
            time_limit_s: float | None = None) -> DryRun:
    """Runs a transform over the table without writing, and reconciles rows.

    All output columns are computed (they feed a fingerprint), so a failing
    expression shows.  Counts come from query results rather than accumulators,
    which a re-run task could add to twice.  Past the time limit, if one is
    given, the run's Spark jobs are cancelled.
    """
    result = DryRun()
    context = df.sparkSession.sparkContext
    tag = f"dry-run-{uuid.uuid4().hex}"
    overtime = threading.Event()

    def cancel() -> None:
        overtime.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(threading.TIMEOUT_MAX if time_limit_s is None else time_limit_s, cancel)
    timer.daemon = True
    start = time.monotonic()
    context.addJobTag(tag)
    if time_limit_s is not None:
        timer.start()
    try:
        result.input_rows = df.count()
        output = df.transform(transform)
        row = table_fingerprint(output).first()
        result.output_rows, result.fingerprint = row["row_count"], row["fingerprint"] or ""
        result.sample_output = [r.asDict() for r in output.limit(SAMPLE_ROWS).collect()]
        result.success = not overtime.is_set()
    except Exception as error:  # a trial run reports whatever the transform raises
        result.errors.append(f"{type(error).__name__}: {error}")
    finally:
        timer.cancel()
        context.removeJobTag(tag)
        result.execution_time_ms = round((time.monotonic() - start) * 1000, 2)
    if overtime.is_set():
        result.success = False
        result.errors.insert(0, f"timed out after {time_limit_s}s")
    return result


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows in, rows out, difference, share kept and whether output is empty."""
    out = after.agg(F.count(F.lit(1))).scalar()
    return before.agg(F.count(F.lit(1)).alias("input_rows")).withColumn("output_rows", out).select(
        "input_rows",
        "output_rows",
        (F.col("output_rows") - F.col("input_rows")).alias("row_delta"),
        F.round(F.try_divide(F.col("output_rows"), F.col("input_rows")), 4).alias("kept_ratio"),
        (F.col("output_rows") == 0).alias("empty_output"),
    )
