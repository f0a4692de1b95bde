"""Append-only tables of run metadata under one root folder."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.operators import runmeta
from tablecare.sources.tables import read_or_empty, read_or_none

# Names under which lineage shows among metrics and events.
ROW_DELTA = "transform_row_delta"
SOURCE_READ = "data_source_read"
SINK_WRITE = "data_sink_write"

_SCHEMAS = {
    "points": runmeta.POINT_SCHEMA,
    "events": runmeta.EVENT_SCHEMA,
    "lineage": runmeta.LINEAGE_SCHEMA,
    "stages": runmeta.STAGE_SCHEMA,
    "watermarks": runmeta.WATERMARK_SCHEMA,
}

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _texts(values: dict | None) -> dict[str, str]:
    return {str(k): str(v) for k, v in (values or {}).items()}


class Mark(NamedTuple):
    """A watermark: a value and, among rows of that value, a tie key."""

    value: str | None
    tie: str | None = None


class RunStore:
    """Writes and reads metrics, events, lineage, stage checkpoints and watermarks.

    Rows are only ever appended; the latest state is a query over them, so runs
    can write at the same time and a repeated write does no harm.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """One of points, events, lineage, stages, watermarks."""
        return read_or_empty(self.spark, f"{self.root}/{name}", _SCHEMAS[name])

    def append(self, name: str, rows: list[tuple]) -> None:
        fields = [f.split(" ", 1) for f in _SCHEMAS[name].split(", ")]
        columns = [
            pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], _ARROW[kind])
            for values, (_, kind) in zip(zip(*rows), fields)
        ]
        # an Arrow table stays with the driver, so a few rows need no Python workers
        frame = self.spark.createDataFrame(pa.table(columns, names=[f for f, _ in fields]))
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    # profiles and findings

    def keep(self, kind: str, rows: DataFrame, run_id: str, name: str) -> None:
        """Stores a run's profile or findings under its id and the name of its input."""
        marked = rows.withColumns({"run_id": F.lit(run_id), "source": F.lit(name), "kept_at": F.lit(_now())})
        marked.coalesce(1).write.mode("append").parquet(f"{self.root}/{kind}")

    def last_kept(self, kind: str, name: str) -> DataFrame | None:
        """The rows of the last run of an input, or None."""
        rows = read_or_none(self.spark, f"{self.root}/{kind}")
        if rows is None:
            return None
        own = rows.where(F.col("source") == name)
        last = own.agg(F.max_by("run_id", "kept_at")).first()[0]
        return None if last is None else own.where(F.col("run_id") == last).drop("run_id", "source", "kept_at")

    # metrics and events

    def record(self, name: str, value: float, labels: dict | None = None, ts: datetime | None = None) -> None:
        self.append("points", [(name, float(value), ts or _now(), _texts(labels))])

    def record_all(self, values: dict[str, float], labels: dict | None = None) -> None:
        now = _now()
        self.append("points", [(n, float(v), now, _texts(labels)) for n, v in values.items()])

    def record_event(self, event_type: str, session_id: str, details: dict | None = None,
                     ts: datetime | None = None) -> None:
        self.append("events", [(event_type, session_id, ts or _now(), _texts(details))])

    # lineage

    def record_nodes(self, session_id: str, nodes: list[dict]) -> None:
        """Appends a run's nodes in order; each has type, name and its row counts.

        Transformations also leave their row difference as a metric, sources and
        sinks an event.
        """
        last = self.table("lineage").filter(F.col("session_id") == session_id).agg(F.max("seq")).first()[0]
        start = 0 if last is None else last + 1
        now = _now()
        rows, points, events = [], [], []
        for i, n in enumerate(nodes):
            rows.append((session_id, start + i, n["type"], n["name"], n.get("input_rows"),
                         n.get("output_rows"), n.get("row_count"), now, _texts(n.get("details"))))
            if n["type"] == "transformation":
                delta = float(n["output_rows"] - n["input_rows"])
                points.append((ROW_DELTA, delta, now, {"transform": n["name"]}))
            elif n["type"] == "source":
                events.append((SOURCE_READ, session_id, now, {"source": n["name"]}))
            else:
                events.append((SINK_WRITE, session_id, now,
                               {"sink": n["name"], "rows": str(n.get("row_count"))}))
        for name, new in (("lineage", rows), ("points", points), ("events", events)):
            if new:
                self.append(name, new)

    # stage checkpoints

    def mark(self, run_id: str, stage: str, status: str, *, input_hash: str = "", output_hash: str = "",
             error: str = "", metadata: dict | None = None, ts: datetime | None = None) -> None:
        """Appends a stage event; status is started, completed or failed."""
        if status not in ("started", "completed", "failed"):
            raise ValueError(f"unknown stage status {status!r}")
        self.append("stages", [(run_id, stage, status, ts or _now(), input_hash, output_hash,
                                error, _texts(metadata))])

    def latest_stages(self) -> DataFrame:
        stages = self.table("stages").withColumn("details", F.to_json("metadata"))
        return runmeta.latest_checkpoint(
            stages, ["run_id", "stage"], ["ts"], ["input_hash", "output_hash", "error", "details"]
        )

    def is_completed(self, run_id: str, stage: str) -> bool:
        found = self.latest_stages().filter((F.col("run_id") == run_id) & (F.col("stage") == stage))
        return not runmeta.completed_stages(found).isEmpty()

    def completed_input(self, stage: str, input_hash: str) -> bool:
        """True when some run has completed this stage on this very input."""
        done = self.table("stages").filter(
            (F.col("stage") == stage) & (F.col("status") == "completed") & (F.col("input_hash") == input_hash)
        )
        return not done.isEmpty()

    def progress(self) -> DataFrame:
        return runmeta.checkpoint_progress(self.latest_stages(), ["run_id"])

    # watermarks

    def get_watermark(self, source: str) -> str:
        """Stored value, or '' for an unknown source."""
        return self._mark(source)[0] or ""

    def _mark(self, source: str) -> tuple[str | None, str | None]:
        row = self.watermarks().filter(F.col("source") == source).first()
        return (row["value"], row["tie"]) if row else (None, None)

    def set_watermark(self, source: str, value: str | Mark, ts: datetime | None = None) -> None:
        """Stores a mark; one below the stored mark changes nothing."""
        value, tie = value if isinstance(value, Mark) else (value, None)
        if value is not None:
            self.append("watermarks", [(source, value, tie, ts or _now())])

    def watermarks(self) -> DataFrame:
        return runmeta.latest_watermarks(self.table("watermarks"))

    def read_since(self, df: DataFrame, source: str, column: str, tie: str | None = None) -> tuple[DataFrame, Mark]:
        """Rows above the stored mark, and the mark to store once they are processed.

        The rows end at that mark, so what arrives meanwhile waits for the next
        read.  With a tie key, rows sharing the boundary value are told apart;
        rows without a tie key come before all others of their value.
        """
        value, key = self._mark(source)
        fresh = runmeta.incremental_since(df, column, value, tie, key) if value is not None else df
        names = [column, *([tie] if tie else [])]
        top = fresh.agg(F.max(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])).alias("m"))
        row = top.select(*[F.col(f"m.c{i}").cast("string") for i in range(len(names))]).first()
        if row[0] is None:
            return fresh.where(F.lit(False)), Mark(value, key)
        mark = Mark(row[0], row[1] if tie else None)
        later = runmeta.above_mark(fresh, column, mark.value, tie, mark.tie)
        return fresh.where(F.col(quoted(column)).isNotNull() & ~F.coalesce(later, F.lit(False))), mark
