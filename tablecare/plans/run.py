"""One quality run from source to sink, with its metadata."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import table_fingerprint
from tablecare.operators.dryrun import DryRun, dry_run
from tablecare.operators.profile import profile_columns
from tablecare.operators.rules import check, report
from tablecare.plans.heal import HealResult, heal
from tablecare.sources.session import cut_lineage, local_copy
from tablecare.sources.store import RunStore
from tablecare.sources.tables import read_table, write_table


class RowLossError(Exception):
    """A repair would lose more rows than allowed."""


class SimulationError(Exception):
    """A trial run of the transform failed or left no rows."""


@dataclass
class RunResult:
    run_id: str
    profile: DataFrame | None = None
    findings: DataFrame | None = None
    report: DataFrame | None = None
    healed: HealResult | None = None
    simulated: DryRun | None = None
    skipped: bool = False


def run(df: DataFrame, target: str, store: RunStore, *, as_of: datetime | str | None = None,
        previous: DataFrame | None = None, name: str = "source", run_id: str | None = None,
        input_hash: str | None = None, max_loss: float = 0.5, exclude: tuple[str, ...] = (),
        transform: Callable[[DataFrame], DataFrame] | None = None, trial_limit_s: float | None = None) -> RunResult:
    """Profiles, checks, repairs and writes a table, recording each stage.

    An input already written by an earlier run is not processed again.  Inputs
    are told apart by `input_hash`; give one (a table version, say) to save the
    scan that fingerprints all values.  A stage that fails is recorded as failed
    and its error raised; so does the repair if it leaves out more than
    `max_loss` of the rows, before anything is written.  Profiles and findings
    are kept in the store; without `previous` drift is judged against the last
    profile of the same name.  A `transform` is tried on the input before the
    repair, which records rows in and out and fails the run if it raises, takes
    longer than `trial_limit_s` or leaves no rows; then it is applied to the
    repaired table, and its result is what is written.
    """
    spark = df.sparkSession
    run_id = run_id or uuid.uuid4().hex[:8]
    result = RunResult(run_id)
    if input_hash is None:
        identity = table_fingerprint(df).first()
        input_hash = f"{identity['row_count']}:{identity['fingerprint']}"
    if store.completed_input("write", input_hash):
        result.skipped = True
        store.record_event("run_skipped", run_id, {"input_hash": input_hash})
        return result
    store.record_event("run_created", run_id, {"source": name})
    timings: dict[str, float] = {}

    def stage(label: str, work):
        store.mark(run_id, label, "started", input_hash=input_hash)
        start = time.monotonic()
        try:
            value, metadata = work()
        except Exception as error:
            store.mark(run_id, label, "failed", input_hash=input_hash, error=str(error))
            store.record("errors_total", 1, {"phase": label, "session_id": run_id})
            store.record_event("run_failed", run_id, {"error": str(error)})
            raise
        timings[f"{label}_duration_ms"] = (time.monotonic() - start) * 1000
        store.mark(run_id, label, "completed", input_hash=input_hash, metadata=metadata)
        return value

    def do_profile():
        nonlocal df
        df = cut_lineage(df)  # the source is read once more, however many scans follow
        profile = local_copy(profile_columns(df))
        store.keep("profiles", profile, run_id, name)
        return profile, {"rows": profile.first()["row_count"]}

    def do_check():
        found = local_copy(check(result.profile, as_of=as_of, previous=last))
        store.keep("findings", found, run_id, name)
        return found, {}

    def do_simulate():
        trial = dry_run(df, transform, trial_limit_s)
        if not trial.success:
            raise SimulationError("; ".join(trial.errors))
        if trial.input_rows and not trial.output_rows:
            raise SimulationError(f"the transform leaves none of {trial.input_rows} rows")
        return trial, {"input_rows": trial.input_rows, "output_rows": trial.output_rows, "row_delta": trial.output_rows - trial.input_rows}

    def do_heal():
        healed = heal(df, as_of=as_of, profile=result.profile, exclude=exclude)
        before, after = (healed.steps.orderBy(order).first()["row_count"] for order in ("iteration", F.desc("iteration")))
        if before and 1 - after / before > max_loss:
            raise RowLossError(f"repair would leave {after} of {before} rows; max_loss is {max_loss}")
        return healed, {"iterations": healed.passes, "unfixed": healed.unfixed}

    def do_write():
        repaired = result.healed.df
        write_table(repaired.transform(transform) if transform else repaired, target)
        return read_table(spark, target).count(), {}

    last = previous if previous is not None else store.last_kept("profiles", name)
    result.profile = stage("profile", do_profile)
    result.findings = stage("check", do_check)
    result.report = report(result.findings)
    score = result.report.first()
    rows = result.profile.first()["row_count"]
    if transform:
        result.simulated = stage("simulate", do_simulate)
    result.healed = stage("heal", do_heal)
    repaired_rows = result.healed.steps.orderBy(F.desc("iteration")).first()["row_count"]
    written = stage("write", do_write)
    store.record_all({
        **timings, "input_rows": rows, "quality_score": score["quality_score"],
        "critical_issues": score["critical_count"],
    }, {"session_id": run_id})
    store.record_nodes(run_id, [
        {"type": "source", "name": name, "row_count": rows},
        {"type": "transformation", "name": "heal", "input_rows": rows, "output_rows": repaired_rows},
        *([{"type": "transformation", "name": "transform", "input_rows": repaired_rows, "output_rows": written}] if transform else []),
        {"type": "sink", "name": target, "row_count": written},
    ])
    store.record_event("run_completed", run_id, {"rows": written})
    return result
