"""Landing of CSV files, each once, with a ledger of what has been landed."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.clean import keep_last
from tablecare.sources.tables import _missing, _raw_csv, read_or_empty, read_or_none

LEDGER_SCHEMA = "batch string, run_id string, path string, file_path string, size bigint, modified timestamp, landed_at timestamp"


class Landing:
    """Rows of landed files under `root`, told apart by file path, size and time of change.

    A batch's rows are written first and its files are entered in the ledger
    last, by one job.  Rows count only once their files are in the ledger, so a
    run that breaks off leaves nothing to clean up and lands its files again.
    A file that was changed is landed anew and its earlier rows no longer count.
    The files of one call share a header; later calls may bring other columns.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._rows, self._ledger = f"{root.rstrip('/')}/rows", f"{root.rstrip('/')}/ledger"

    def ledger(self) -> DataFrame:
        return read_or_empty(self.spark, self._ledger, LEDGER_SCHEMA)

    def pending(self, source: str) -> DataFrame:
        """path, file_path, size and modified of the files that are new or changed; none of them is opened."""
        try:
            listed = self.spark.read.format("binaryFile").load(source)
        except AnalysisException as error:
            if not _missing(error):
                raise
            return self.ledger().select("path", "file_path", "size", "modified").limit(0)
        files = listed.select("path", "_metadata.file_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        return files.join(self.ledger(), ["file_path", "size", "modified"], "left_anti").select("path", "file_path", "size", "modified")

    def land(self, source: str, run_id: str, **options) -> DataFrame:
        """Lands what is pending and returns the files' ledger entries."""
        spark, batch = self.spark, uuid.uuid4().hex
        files = self.pending(source).collect()  # names only, as Spark's own listing of the source holds them
        if not files:
            return spark.createDataFrame([], LEDGER_SCHEMA)
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f["path"]) for f in files]
        raw = _raw_csv(spark, paths, options.get("separator", ","), options.get("multi_line", False), source=True)
        raw.write.parquet(f"{self._rows}/_batch={batch}")
        now = datetime.now(timezone.utc)
        entries = spark.createDataFrame([(batch, run_id, f["path"], f["file_path"], f["size"], f["modified"], now) for f in files], LEDGER_SCHEMA)
        entries.coalesce(1).write.mode("append").parquet(self._ledger)
        return entries

    def rows(self) -> DataFrame | None:
        """All rows of landed files as they were last, with file_name and run_id; None before the first."""
        if read_or_none(self.spark, self._ledger) is None:
            return None
        batches = self.spark.read.option("mergeSchema", True).parquet(self._rows)
        latest = keep_last(self.ledger(), ["file_path"], ["landed_at", "batch"]).select(F.col("batch").alias("_batch"), F.col("file_path").alias("_file"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "run_id")
        return batches.join(latest, ["_batch", "_file"]).drop("_batch", "_file")
