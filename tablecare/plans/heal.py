"""Repair of a table by rule: findings, fix plan, transforms, new findings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.functions.pii import redact
from tablecare.operators import changes, clean
from tablecare.operators.personal import remedy_columns
from tablecare.operators.profile import ALL_MEASURES, profile_columns
from tablecare.operators.rules import check, report
from tablecare.sources.session import cut_lineage, local_copy

#: How the profile says that a column's name, not its values, told the type.
BY_NAME = "column_name_match"

# Fixed value: passes after which repair stops.
MAX_PASSES = 2

HISTORY_SCHEMA = "iteration int, rule string, column string, issue string, fix string"
STEP_SCHEMA = "iteration int, row_count bigint, findings bigint, quality_score int"


@dataclass(frozen=True)
class Fix:
    rule: str
    column: str
    issue: str
    action: str
    detail: str = ""


@dataclass
class HealResult:
    df: DataFrame
    history: DataFrame
    before: DataFrame
    after: DataFrame
    passes: int
    remedied: tuple[str, ...]
    #: Per pass, from 0 (the table as it came): rows, findings and score.
    steps: DataFrame
    #: Fixable findings left when the passes were used up.
    unfixed: int
    #: What each pass changed, if keys for a log were given.
    logs: tuple[changes.PassLog, ...] = ()
    log_keys: tuple[str, ...] = ()

    def changes(self) -> DataFrame:
        """iteration, key, column, old, new, fix and copies of everything the passes changed."""
        if not self.log_keys:
            raise ValueError("heal(..., log_keys=[...]) keeps a log of changes")
        if self.logs:
            return changes.cells(list(self.logs))
        key = F.struct(*[F.col(quoted(k)) for k in self.log_keys]).alias("key")
        nothing = [F.lit(None).cast("string").alias(c) for c in ("column", "old", "new", "fix")]
        return self.df.select(F.lit(0).alias("iteration"), key, *nothing, F.lit(0).cast("bigint").alias("copies")).limit(0)

    def undo(self) -> DataFrame:
        """The table as it came, from the repaired one and the log."""
        if not self.log_keys:
            raise ValueError("heal(..., log_keys=[...]) keeps a log of changes")
        df = self.df
        for log in reversed(self.logs):
            df = changes.undo_pass(df, list(self.log_keys), log)
        return df

    def report(self) -> DataFrame:
        """Findings and points per rule before and after."""
        def per_rule(findings: DataFrame, when: str) -> DataFrame:
            return findings.groupBy("rule").agg(
                F.count(F.lit(1)).alias(f"findings_{when}"), F.sum("points").alias(f"points_{when}")
            )

        both = per_rule(self.before, "before").join(per_rule(self.after, "after"), "rule", "full_outer")
        return both.select("rule", *[
            F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("findings_before", "points_before", "findings_after", "points_after")
        ])

    def scores(self) -> DataFrame:
        """One row: quality score before and after."""
        after = report(self.after).select("quality_score").scalar()
        return report(self.before).select(F.col("quality_score").alias("score_before")).withColumn(
            "score_after", after
        )


def _imputation(semantic: str) -> str:
    if semantic == "float":
        return "fill_mean"
    if semantic == "integer":
        return "fill_median"
    if semantic in ("string", "boolean"):
        return "fill_mode"
    return "flag_nulls"


def plan(findings: list[Row], profile: list[Row], done: set[tuple[str, str]]) -> list[Fix]:
    """Fixes for the findings that have one, leaving out pairs already treated.

    A column that is dropped gets no other fix.
    """
    semantic = {r["column"]: r["semantic_type"] for r in profile}
    kinds = {r["column"]: (r["pii_type"], r["pii_method"]) for r in profile}
    open_findings = [f for f in findings if (f["rule"], f["column"]) not in done]

    def fix(f: Row, action: str, detail: str = "") -> Fix:
        return Fix(f["rule"], f["column"], f["description"], action, detail)

    drops = [
        fix(f, "drop_column") for f in open_findings
        if f["rule"] == "low_cardinality" or (f["rule"] == "null_threshold" and f["severity"] == "critical")
    ]
    gone = {f.column for f in drops}
    # a table keeps at least one column
    if len(gone) == len(semantic):
        drops, gone = [], set()
    fixes = list(drops)
    for f in open_findings:
        if f["column"] in gone:
            continue
        rule, column = f["rule"], f["column"]
        if rule == "duplicate_threshold":
            fixes.append(fix(f, "dedup_exact"))
        elif rule == "pii_detected":
            kind, method = kinds[column]
            fixes.append(fix(f, "remedy", kind) if method == BY_NAME else fix(f, "redact"))
        elif rule == "type_consistency":
            fixes.append(fix(f, "safe_cast", "double"))
        elif rule == "negative_values":
            fixes.append(fix(f, "clip_negative"))
        elif rule == "outlier_detection":
            fixes.append(fix(f, "cap_outliers"))
        elif rule == "null_threshold" and f["severity"] != "critical":
            fixes.append(fix(f, _imputation(semantic[column])))
    return fixes


def _columns(fixes: list[Fix], action: str) -> list[str]:
    return list(dict.fromkeys(f.column for f in fixes if f.action == action))


def apply(df: DataFrame, fixes: list[Fix], salt: str = "") -> tuple[DataFrame, set[str]]:
    """Table after the fixes, and the columns whose cast was left out.

    Repeated rows go first, judged on all columns as they came, so that rows
    differing in a column dropped or masked here stay apart.  A column found
    personal by its values has every match of every type replaced in the text;
    one found by its name is treated whole.  A column is cast only if no value
    is lost or changed by that.  Statistics are taken from the table as this
    half left it, which is written out for them and for later passes.
    """
    out = clean.dedup_exact(df) if _columns(fixes, "dedup_exact") else df
    out = out.drop(*_columns(fixes, "drop_column"))
    personal = {f.column: f.detail for f in fixes if f.action == "remedy"}
    if personal:
        out = remedy_columns(out, personal, salt)
    texts = [c for c in _columns(fixes, "redact") if c not in personal]
    if texts:
        out = redact(out.select(*[F.col(quoted(c)).cast("string").alias(c) if c in texts else F.col(quoted(c)) for c in out.columns]), texts)
    treated = {*personal, *texts}
    casts = {f.column: f.detail for f in fixes if f.action == "safe_cast" and f.column not in treated}
    # whether a value is lost shows in the table with its repeats, which needs no shuffle of rows
    uncast = {r["column"] for r in clean.cast_losses(df, casts).collect() if r["lost"]} if casts else set()
    if casts.keys() - uncast:
        out = clean.safe_cast(out, {c: t for c, t in casts.items() if c not in uncast})
    numeric = lambda cs: [c for c in cs if c not in treated]
    if negative := numeric(_columns(fixes, "clip_negative")):
        out = clean.clip_negative(out, negative)
    out = cut_lineage(out)
    if capped := numeric(_columns(fixes, "cap_outliers")):
        out = clean.cap_outliers(out, capped)
    if means := numeric(_columns(fixes, "fill_mean")):
        out = clean.fill_mean(out, means)
    if medians := clean.exact_medians(out, numeric(_columns(fixes, "fill_median"))):
        out = clean.fill_constant(out, {c: int(m // 1) for c, m in medians.items() if m is not None})
    if modes := _columns(fixes, "fill_mode"):
        out = clean.fill_mode(out, [c for c in modes if c in out.columns])
    if flags := _columns(fixes, "flag_nulls"):
        out = clean.flag_nulls(out, flags)
    return out, uncast


def _wanted(fixes: list[Fix], exclude: tuple[str, ...]) -> list[Fix]:
    return [f for f in fixes if not {f.rule, f.column, f.action} & set(exclude)]


def preview(df: DataFrame, *, as_of: datetime | str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The fixes that a first pass would make, as rows (rule, column, issue, fix); nothing is changed."""
    small = local_copy(profile_columns(df, ALL_MEASURES, approx=True))
    fixes = _wanted(plan(check(small, as_of=as_of).collect(), small.collect(), set()), exclude)
    rows = [(f.rule, f.column, f.issue, f.action) for f in fixes]
    return df.sparkSession.createDataFrame(rows, "rule string, column string, issue string, fix string")


def heal(df: DataFrame, *, as_of: datetime | str | None = None, max_passes: int = MAX_PASSES,
         salt: str = "", profile: DataFrame | None = None, exclude: tuple[str, ...] = (),
         log_keys: tuple[str, ...] | list[str] = ()) -> HealResult:
    """Repairs a table until nothing fixable is found or the passes are used up.

    A `profile` of the table as it is saves the first profiling.  `exclude`
    names rules, columns or fixes to leave out.  Only profiles and findings,
    which the schema bounds, come to the driver; rows stay in tables.  Rows go
    only as repeats of the table as it came.  A column treated whole for its
    name is not reported again for that name.  With `log_keys`, columns that
    tell rows apart and are left as they are, every pass writes what it changed.
    """
    spark = df.sparkSession
    logs: list[changes.PassLog] = []
    exclude = (*exclude, *log_keys)
    done: set[tuple[str, str]] = set()
    remedied: tuple[str, ...] = ()
    history: list[tuple] = []
    steps: list[tuple] = []
    before = None
    passes = 0
    if profile is None:
        df = cut_lineage(df)  # read by several scans and by the first pass
    repeated = bool(log_keys) and changes.repeated_keys(df, list(log_keys))
    while True:
        if passes or profile is None:
            # the rules ask only whether all values are equal, or all different
            profile = profile_columns(df, ALL_MEASURES, pii_exempt=remedied, approx=True)
        small = local_copy(profile)
        profile_rows = small.collect()
        current = local_copy(check(small, as_of=as_of))
        found = current.collect()
        before = before if before is not None else current
        rows = profile_rows[0]["row_count"] if profile_rows else 0
        steps.append((passes, rows, len(found), report(current).first()["quality_score"]))
        if passes:  # rows made equal by a fix are no repeats
            done |= {(f["rule"], f["column"]) for f in found if f["rule"] == "duplicate_threshold"}
        fixes = _wanted(plan(found, profile_rows, done), exclude)
        if not fixes or passes >= max_passes:
            break
        passes += 1
        came = df
        df, uncast = apply(df, fixes, salt)
        if log_keys:
            df = cut_lineage(df)
            made: dict[str, list[str]] = {}
            for f in fixes:
                if f.column in came.columns and not (f.action == "safe_cast" and f.column in uncast):
                    made.setdefault(f.column, []).append(f.action)
            logs.append(changes.log_pass(came, df, list(log_keys), made, repeated))
        done |= {(f.rule, f.column) for f in fixes}
        remedied += tuple(f.column for f in fixes if f.action == "remedy")
        action = lambda f: "keep_text" if f.action == "safe_cast" and f.column in uncast else f.action
        history += [(passes, f.rule, f.column, f.issue, action(f)) for f in fixes]
    return HealResult(
        df, spark.createDataFrame(history, HISTORY_SCHEMA), before, current, passes, remedied,
        spark.createDataFrame(steps, STEP_SCHEMA), len(fixes), tuple(logs), tuple(log_keys),
    )
