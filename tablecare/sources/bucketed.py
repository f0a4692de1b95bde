"""A table in buckets by key hash, whose manifest says which files are current.

An upsert reads and writes the buckets of its keys only.  New files lie beside
the old ones until a new manifest names them: the manifest's appearance under
its number is the commit, so a reader sees one version or the next and never a
mixture, and a run that ends early leaves files that nothing names.  Of two
writers that start from the same version, the second finds the number taken and
fails without a trace in the table.

    data/<name>/bucket=<n>/    rows of one bucket, written by one run
    manifests/<version>.json   schema, keys and the folder of each bucket
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.hashing import quoted, row_key_sql
from tablecare.operators.clean import keep_last, upsert
from tablecare.sources.session import cut_lineage

_BUCKET = "__bucket"


class ConflictError(RuntimeError):
    """Another run has committed since this one began."""


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # manifests, by the file system that Spark uses

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm, place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        _, place, fs = self._files()
        if not fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema, keys, buckets (number of buckets) and folders (by bucket) of a version, the current one by default."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "keys": self.keys, "buckets": self.buckets, "folders": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        """Writes a manifest aside and gives it its number, which only one writer can."""
        jvm, place, fs = self._files()
        fs.mkdirs(place)
        aside = jvm.org.apache.hadoop.fs.Path(place, f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        named = jvm.org.apache.hadoop.fs.Path(place, f"{version}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(named.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(named), options)
        except Exception as error:  # py4j wraps what the file system says
            if fs.exists(named):
                raise ConflictError(f"version {version} exists") from error
            raise

    # rows

    def _bucket(self, schema: T.StructType, buckets: int) -> Column:
        a, _ = row_key_sql(T.StructType([schema[k] for k in self.keys]))
        return F.expr(f"CAST(pmod({a}, {buckets}) AS int)")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the current one by default."""
        return self._read(self.manifest(version))

    def upsert(self, batch: DataFrame, order_by: list[str] | None = None) -> list[int]:
        """Adds the batch's rows, each in place of the row of its key; returns the buckets written.

        The same batch again gives the same rows.  ``order_by`` picks the last
        row of a key that the batch repeats; without it keys must be unique.
        """
        before = self.version()
        manifest = self.manifest(before)
        schema, count = batch.schema, manifest["buckets"]
        if manifest["schema"] is not None:
            known = T.StructType.fromJson(manifest["schema"])
            batch = batch.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in known])
            schema = known
        bucket = self._bucket(schema, count)
        last = cut_lineage((keep_last(batch, self.keys, order_by) if order_by else batch).withColumn(_BUCKET, bucket))
        touched = sorted(r[0] for r in last.select(_BUCKET).distinct().collect())  # at most the number of buckets
        if not touched:
            return []
        rows = last.drop(_BUCKET)
        old = [b for b in touched if str(b) in manifest["folders"]]
        merged = upsert(self._read(manifest, old), rows, self.keys) if old else rows
        name = f"data/{uuid.uuid4().hex}"
        merged.withColumn(_BUCKET, bucket).withColumn("bucket", F.col(_BUCKET)).repartition(len(touched), _BUCKET).drop(_BUCKET).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        folders = manifest["folders"] | {str(b): f"{name}/bucket={b}" for b in touched}
        self._commit(before + 1, {"schema": json.loads(schema.json()), "keys": self.keys, "buckets": count, "folders": folders})
        return touched

    # differences

    def digests(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """bucket, row_count and an order-free hash of the rows of each bucket."""
        manifest = self.manifest(version)
        rows = self._read(manifest, buckets)
        a, b = row_key_sql(rows.schema)
        return rows.groupBy(self._bucket(rows.schema, manifest["buckets"]).alias("bucket")).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(F.expr(f"CAST({a} AS decimal(20,0))")).alias("a"), F.sum(F.expr(f"CAST({b} AS decimal(20,0))")).alias("b")
        )

    def differing(self, old: int, new: int) -> list[int]:
        """Buckets whose rows differ between two versions.

        Buckets of the same folder are equal unread; of the others the order-free
        hashes are compared, so a bucket written anew with equal rows is equal too.
        """
        left, right = self.manifest(old), self.manifest(new)
        if left["buckets"] != right["buckets"]:
            raise ValueError("versions of different bucket counts")
        moved = sorted(int(b) for b in left["folders"].keys() | right["folders"].keys() if left["folders"].get(b) != right["folders"].get(b))
        if not moved or left["schema"] is None or right["schema"] is None:
            return moved
        both = self.digests(old, moved).alias("l").join(self.digests(new, moved).alias("r"), "bucket", "full")
        same = F.expr("l.row_count <=> r.row_count AND l.a <=> r.a AND l.b <=> r.b")
        return sorted(r["bucket"] for r in both.where(~same).select("bucket").collect())

    def changes(self, old: int, new: int) -> DataFrame:
        """The keys, and whether each was added, removed or changed, between two versions; only buckets that differ are joined."""
        buckets = self.differing(old, new)
        kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in self.read(new).schema.fields if f.name in self.keys)
        if not buckets:
            return self.spark.createDataFrame([], f"{kinds}, change string")
        sides = []
        for side, version in (("l", old), ("r", new)):
            manifest = self.manifest(version)
            rows = self.spark.createDataFrame([], self.read(new).schema) if manifest["schema"] is None else self._read(manifest, buckets)
            a, b = row_key_sql(rows.schema)
            sides.append(rows.selectExpr(*[f"{quoted(k)} AS {side}{i}" for i, k in enumerate(self.keys)], f"{a} AS {side}_a", f"{b} AS {side}_b"))
        same = F.expr(" AND ".join(f"l{i} <=> r{i}" for i in range(len(self.keys))))
        change = F.expr("CASE WHEN l_a IS NULL THEN 'added' WHEN r_a IS NULL THEN 'removed' ELSE 'changed' END")
        met = sides[0].join(sides[1], same, "full").where("NOT (l_a <=> r_a AND l_b <=> r_b)")
        key = [F.expr(f"CASE WHEN r_a IS NULL THEN l{i} ELSE r{i} END").alias(k) for i, k in enumerate(self.keys)]
        return met.select(*key, change.alias("change"))

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of the given keys; returns the buckets written."""
        before = self.version()
        manifest = self.manifest(before)
        if manifest["schema"] is None:
            return []
        schema = T.StructType.fromJson(manifest["schema"])
        gone = cut_lineage(keys.select(*[F.col(quoted(k)).cast(schema[k].dataType).alias(k) for k in self.keys]).distinct().withColumn(_BUCKET, self._bucket(schema, manifest["buckets"])))
        touched = [b for b in sorted(r[0] for r in gone.select(_BUCKET).distinct().collect()) if str(b) in manifest["folders"]]
        if not touched:
            return []
        named = gone.select(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(self.keys)])
        left = self._read(manifest, touched).join(named, [F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)], "left_anti")
        name = f"data/{uuid.uuid4().hex}"
        parted = cut_lineage(left.withColumn("bucket", self._bucket(schema, manifest["buckets"])))
        parted.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        held = {r[0] for r in parted.select("bucket").distinct().collect()}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {str(b): f"{name}/bucket={b}" for b in held}
        self._commit(before + 1, manifest | {"folders": folders})
        return touched
