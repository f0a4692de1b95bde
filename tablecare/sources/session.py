"""Where a job may keep intermediate tables."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names.

    A local session without one gets a temporary folder; a cluster must name
    its own, since tasks on other machines could not reach such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablecare-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/tablecare/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    What is on shared storage outlives lost executors, and later passes read
    columns selectively instead of repeating the work.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffles and broadcasts of queries that are done; Spark removes them with the driver's garbage.

    Listeners hear of a query's end a moment after it, and hold its plan until then.
    """
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


def local_copy(df: DataFrame) -> DataFrame:
    """A small result held by the driver, so what is derived from it needs no job.

    Only for results the schema bounds, such as profiles and findings.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)
