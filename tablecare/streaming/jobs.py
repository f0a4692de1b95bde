"""Incremental forms of the operators under Structured Streaming.

Each job processes what is new since its checkpoint and stops; offsets and
state live in the checkpoint folder, so a restarted job goes on where it was.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.hashing import quoted, row_key_sql
from tablecare.operators.profile import ALL_MEASURES, profile_columns
from tablecare.operators.rules import check
from tablecare.sources.session import cut_lineage
from tablecare.sources.tables import read_or_empty, read_or_none


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, files_per_batch: int | None = 1000) -> DataFrame:
    """Files of a folder as a stream; a batch takes a bounded number of files, the rest follows in further ones."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def append_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends rows that arrived since the last run to a parquet table, each exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
    query.awaitTermination()


def drop_repeats(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> None:
    """Appends the first row of each key to a parquet table, however late it comes.

    What a batch brings is compared with keys already written, found by their
    index (``KeyIndex``), so no state grows with the stream, no unique row is
    lost for being late, and only files that may hold a key of the batch are
    opened.  A batch replayed after a failure overwrites its own rows.
    """
    index = KeyIndex(stream.sparkSession, f"{target}/_index", [f for f in stream.schema.fields if f.name in keys])

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch.dropDuplicates(keys))
        index.without(fresh, batch_id).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        index.add(stream.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch_id={batch_id}"), batch_id)

    _run(stream.writeStream.foreachBatch(add), checkpoint)


class KeyIndex:
    """Keys of written batches, in slices by hash, with a Bloom filter and key range for every few thousand of them.

    ``keys/batch_id=/slice=`` holds the keys of a batch, ``filters/batch_id=``
    a row for each of its filters: the hash prefix it is for, the least and
    greatest first key column, and the bits.
    """

    #: Keys a filter is meant for: of other keys it lets about one in a hundred pass.
    KEYS = 3000
    SLICE_BITS, BITS = 4, 1 << 15

    def __init__(self, spark: SparkSession, path: str, fields: list[T.StructField]):
        self.spark, self.path, self.fields = spark, path, fields
        kind = fields[0].dataType.simpleString()
        self.filters_schema = f"depth int, prefix bigint, slice int, low {kind}, high {kind}, bits binary, batch_id bigint"

    def _hashed(self, df: DataFrame) -> DataFrame:
        """The key columns as k0, k1 and so on, and two hashes of them."""
        a, b = row_key_sql(T.StructType(self.fields))
        names = [f"{quoted(f.name)} AS k{i}" for i, f in enumerate(self.fields)]
        return df.selectExpr(*names, f"{a} AS a", f"{b} AS b")

    @staticmethod
    def _prefix(depth: int | str) -> Column:
        """The first bits of a hash; a shift by 64 would be one by none."""
        return F.expr(f"CASE WHEN {depth} > 0 THEN shiftrightunsigned(a, 64 - {depth}) ELSE 0L END")

    @staticmethod
    def _places() -> list[str]:
        """Four places of a key among a filter's bits."""
        return [f"(shiftrightunsigned(b, {15 * i}) & {KeyIndex.BITS - 1})" for i in range(4)]

    def add(self, written: DataFrame, batch_id: int) -> None:
        """Keeps the keys of a written batch; repeated for the same batch, it replaces them."""
        keys = self._hashed(written)
        n = keys.count()
        depth = max(0, math.ceil(math.log2(max(n, 1) / self.KEYS)))
        slices = min(depth, self.SLICE_BITS)
        sliced = keys.withColumn("slice", self._prefix(slices).cast("int")).withColumn("prefix", self._prefix(depth))
        own = [f"k{i}" for i in range(len(self.fields))]
        sliced.select(*own, "slice").repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/keys/batch_id={batch_id}")
        places = sliced.select("prefix", "slice", "k0", F.explode(F.expr(f"array({', '.join(self._places())})")).alias("place"))
        filters = places.groupBy("prefix", "slice").agg(F.min("k0").alias("low"), F.max("k0").alias("high"), F.bitmap_construct_agg("place").alias("bits"))
        filters.select(F.lit(depth).alias("depth"), "prefix", "slice", "low", "high", "bits").write.mode("overwrite").parquet(f"{self.path}/filters/batch_id={batch_id}")

    def filters(self, batch_id: int) -> DataFrame:
        """Those of all other batches."""
        return read_or_empty(self.spark, f"{self.path}/filters", self.filters_schema).where(F.col("batch_id") != batch_id)

    def opened(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """batch_id and slice of the keys that a batch must be compared with."""
        filters, keys = self.filters(batch_id), self._hashed(batch)
        ends = keys.agg(F.min("k0").alias("low"), F.max("k0").alias("high"), F.count_if(F.col("k0").isNull()).alias("nulls")).first()
        kind = self.fields[0].dataType
        if not ends["nulls"] and ends["low"] is not None:
            in_reach = (F.col("high") >= F.lit(ends["low"]).cast(kind)) & (F.col("low") <= F.lit(ends["high"]).cast(kind))
            filters = filters.where(F.coalesce(in_reach, F.lit(True)))
        depths = [r["depth"] for r in filters.select("depth").distinct().collect()]  # forty at most
        if not depths:
            return filters.select("batch_id", "slice")
        asked = keys.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", self._prefix("depth"))
        met = asked.join(filters, ["depth", "prefix"])
        byte = "CAST(conv(hex(substring(bits, CAST(({p} DIV 8) + 1 AS int), 1)), 16, 10) AS int)"
        held = " AND ".join(f"getbit({byte.format(p=p)}, CAST({p} % 8 AS int)) = 1" for p in self._places())
        return met.where(F.expr(held)).where("coalesce(k0 BETWEEN low AND high, true)").select("batch_id", "slice").distinct()

    def without(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch whose keys no other batch has."""
        files = [f"{self.path}/keys/batch_id={r['batch_id']}/slice={r['slice']}" for r in self.opened(batch, batch_id).collect()]
        if not files:
            return batch
        kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(self.fields))
        old = self.spark.read.schema(kinds).parquet(*files)
        same = [F.col(quoted(f.name)).eqNullSafe(F.col(f"k{i}")) for i, f in enumerate(self.fields)]
        return batch.join(old, same, "left_anti")


def _run(writer, checkpoint: str) -> None:
    """Processes all that is there and stops."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quality_batches(stream: DataFrame, target: str, checkpoint: str,
                    as_of: datetime | str | None = None) -> None:
    """Checks every micro-batch and keeps its findings under its batch number.

    A batch replayed after a failure overwrites its own findings.
    """
    def judge(batch: DataFrame, batch_id: int) -> None:
        # the profile reads the batch twice
        batch.persist()
        try:
            findings = check(profile_columns(batch, ALL_MEASURES), as_of=as_of)
            findings.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    _run(stream.writeStream.foreachBatch(judge), checkpoint)


def windowed_errors(stream: DataFrame, ts: str, window: str, lateness: str, keys: list[str],
                    is_error: Column, target: str, checkpoint: str, nullable: list[str] | tuple[str, ...] = ()) -> None:
    """Events, errors and nulls of columns per tumbling window of event time.

    Every batch leaves its own sums, which ``latest_windows`` adds up, so a row
    counts however late it comes and no state is held.  Rows of the same batch
    or later that are older than the latest time of earlier batches less
    ``lateness`` are noted for ``late_rows``.  Rows without a time have a window
    of their own, null.  A batch replayed after a failure overwrites its sums.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = read_or_empty(spark, f"{target}/parts", "seen_until timestamp, batch_id bigint").where(F.col("batch_id") < batch_id)
        merged = read_or_empty(spark, f"{target}/merged", "seen_until timestamp")
        seen = before.select("seen_until").unionByName(merged.select("seen_until")).agg(F.max("seen_until")).first()[0]
        timed = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        late = F.col(ts) < F.lit(seen) - F.expr(f"INTERVAL {lateness}") if seen is not None else F.lit(False)
        sums = [
            F.count(F.lit(1)).alias("events_total"), F.count_if(is_error).alias("errors_total"), F.count_if(late).alias("late_total"),
            F.max(ts).alias("seen_until"), *[F.count_if(F.col(quoted(c)).isNull()).alias(f"__nulls{i}") for i, c in enumerate(nullable)],
        ]
        own = [F.col(quoted(k)) for k in keys]
        dated = timed.groupBy(F.window(ts, window).alias("w"), *own).agg(*sums)
        undated = timed.where(F.col(ts).isNull()).groupBy(*own).agg(*sums).where("events_total > 0").withColumn("window_start", F.lit(None).cast("timestamp"))
        parts = dated.withColumn("window_start", F.col("w.start")).drop("w").unionByName(undated)
        parts.write.mode("overwrite").parquet(f"{target}/parts/batch_id={batch_id}")

    _run(stream.writeStream.foreachBatch(keep), checkpoint)


def _window_sums(spark: SparkSession, target: str) -> DataFrame:
    """Sums of the last compaction and of the batches since."""
    merged, parts = read_or_none(spark, f"{target}/merged"), spark.read.parquet(f"{target}/parts")
    if merged is None:
        return parts.drop("batch_id")
    last = merged.agg(F.max("upto")).first()[0]
    return merged.where(F.col("upto") == last).drop("upto").unionByName(parts.where(F.col("batch_id") > last).drop("batch_id"))


def _added_windows(sums: DataFrame) -> DataFrame:
    added = [c for c in sums.columns if c in ("events_total", "errors_total", "late_total") or c.startswith("__nulls")]
    keys = [c for c in sums.columns if c not in (*added, "seen_until")]
    return sums.groupBy(*[quoted(k) for k in keys]).agg(*[F.sum(c).alias(c) for c in added], F.max("seen_until").alias("seen_until"))


def compact_windows(spark: SparkSession, target: str) -> None:
    """Adds up the sums of all batches but the last, which may be replayed; readers go on from there."""
    last = spark.read.parquet(f"{target}/parts").agg(F.max("batch_id")).first()[0] - 1
    old = read_or_none(spark, f"{target}/merged")
    done = -1 if old is None else old.agg(F.max("upto")).first()[0]
    if last <= done:
        return
    parts = spark.read.parquet(f"{target}/parts").where(F.col("batch_id").between(done + 1, last)).drop("batch_id")
    sums = parts if old is None else parts.unionByName(old.where(F.col("upto") == done).drop("upto"))
    _added_windows(sums).write.mode("overwrite").parquet(f"{target}/merged/upto={last}")


def latest_windows(spark: SparkSession, target: str, keys: list[str], nullable: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Each window as of now: events, errors and, for the columns the job was given, the share of nulls in percent."""
    shares = [F.round(F.col(f"__nulls{i}") * 100.0 / F.col("events_total"), 2).alias(f"{c}_null_percent") for i, c in enumerate(nullable)]
    return _added_windows(_window_sums(spark, target)).select("window_start", *[quoted(k) for k in keys], "events_total", "errors_total", *shares)


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """batch_id, window_start and late_total of every batch that brought rows later than the bound."""
    return spark.read.parquet(f"{target}/parts").where("late_total > 0").groupBy("batch_id", "window_start").agg(F.sum("late_total").alias("late_total"))
