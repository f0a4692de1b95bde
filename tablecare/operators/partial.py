"""Profiles kept as mergeable state, one state for each part of a table.

A part's state holds for every column what can be added up: counts, extremes,
mean and squared deviations, evidence of types, dates and personal data, and a
HyperLogLog sketch of its values; one more row has a sketch of whole rows.  The
profile of all parts is the merge of their states, so a new part is the only
one read.

All measures are those of ``profile_columns`` in full mode but for
``unique_count`` and ``duplicate_rows``, which the sketches estimate: up to
about a thousand distinct values they count exactly, beyond that with a
relative standard error of ``SKETCH_ERROR``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.hashing import is_nested, quoted, row_key_sql, value_key_sql
from tablecare.operators.profile import (
    ALL_MEASURES, SCAN_BUDGET, base_semantic_type, column_aggregates, described, finite_sql, _scan_groups, scan_inputs, struct_sql,
)
from tablecare.sources.tables import read_or_empty

#: Sketches have 2^14 registers.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)

#: The place of the row that stands for whole rows.
ROWS = -1

STATE = (
    "part string, position int, column string, dtype string, base_type string, name_pii string, row_count bigint, non_null bigint,"
    " min double, max double, finite bigint, mean double, m2 double, text_values bigint, numeric_values bigint, date_fits int,"
    " pii_hits array<bigint>, latest timestamp_ntz, sketch binary"
)
_STORED = f"{STATE}, fingerprint string, added bigint, run string"
_FIELDS = [f.strip().split(" ")[0] for f in STATE.split(",")]


def part_states(df: DataFrame, part: str, *, scan_all_types: bool = False, pii_exempt: tuple[str, ...] = (), scan_budget: int = SCAN_BUDGET) -> DataFrame:
    """One row for each part, the values of the column ``part`` as text ('' for null), and column, and one for its whole rows."""
    data = df.drop(part)
    name = f"coalesce(CAST({quoted(part)} AS string), '') AS __part"
    exempt, found = set(pii_exempt), []
    for group in _scan_groups(data.schema, scan_budget):
        structs = []
        for i, f in group:
            sums = column_aggregates(i, f, ALL_MEASURES, True, exempt, scan_all_types)
            own = {"finite": "CAST(0 AS bigint)", "mean": "CAST(null AS double)", "m2": "CAST(null AS double)"}
            if base_semantic_type(f.dataType) in ("integer", "float"):
                finite = finite_sql(f)
                own = {"finite": f"count({finite})", "mean": f"avg({finite})", "m2": f"var_pop({finite}) * count({finite})"}
            structs.append(struct_sql({k: v for k, v in sums.items() if k not in ("mean", "std")} | own))
        needed = scan_inputs(group, ALL_MEASURES, True, exempt, scan_all_types)
        scanned = df.selectExpr(name, *needed).groupBy("__part").agg(F.expr(f"array({', '.join(structs)})").alias("columns"))
        found.append(scanned.selectExpr("__part AS part", "inline(columns)"))
    return reduce(DataFrame.unionByName, found).join(_sketches(df, data, name), ["part", "position"], "full").selectExpr(*[
        f"coalesce({c}, '') AS {c}" if c == "column" else f"coalesce({c}, n) AS {c}" if c == "row_count" else c for c in _FIELDS
    ])


def _sketches(df: DataFrame, data: DataFrame, name: str) -> DataFrame:
    """part, position, n and the sketch of each column's values; at ``ROWS`` that of whole rows."""
    keys = {i: value_key_sql(f) for i, f in enumerate(data.schema.fields) if not is_nested(f.dataType)}
    keys[ROWS] = row_key_sql(data.schema)
    both = [f"xxhash64({a}, {b}) AS `{i}`" if i == ROWS else f"CASE WHEN {a} IS NOT NULL THEN xxhash64({a}, {b}) END AS `{i}`" for i, (a, b) in keys.items()]
    sketches = [f"struct({i} AS position, hll_sketch_agg(`{i}`, {SKETCH_BITS}) AS sketch)" for i in keys]
    one = df.selectExpr(name, *both).groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.expr(f"array({', '.join(sketches)})").alias("s"))
    return one.selectExpr("__part AS part", "n", "inline(s)")


def merged(states: DataFrame) -> DataFrame:
    """The profile of all parts together, in the form of ``profile_columns``."""
    grand = states.groupBy("position").agg((F.sum(F.col("finite") * F.col("mean")) / F.sum("finite")).alias("grand"))  # a row a column
    hits = [f"sum(coalesce(pii_hits[{i}], 0)) AS h{i}" for i in range(len(_kinds()))]
    sums = states.join(F.broadcast(grand), "position").groupBy("position", "column", "dtype", "base_type", "name_pii").agg(
        *[F.expr(e) for e in (
            "sum(row_count) AS row_count", "sum(non_null) AS non_null", "min(min) AS min", "max(max) AS max",
            "round(first(grand), 2) AS mean", "sum(finite) AS n", "sum(m2 + finite * power(mean - grand, 2)) AS m2",
            "sum(text_values) AS text_values", "sum(numeric_values) AS numeric_values", "bit_and(date_fits) AS date_fits",
            "max(latest) AS latest", "hll_sketch_estimate(hll_union_agg(sketch)) AS distinct_values", "count(pii_hits) AS judged", *hits,
        )]
    )
    evidence = sums.selectExpr(
        "*", "CASE WHEN n > 1 THEN round(sqrt(m2 / (n - 1)), 2) END AS std", "non_null AS date_trials", "CAST(null AS string) AS first_pii",
        f"CASE WHEN judged > 0 THEN array({', '.join(f'h{i}' for i in range(len(_kinds())))}) END AS pii_hits",
    )
    columns = evidence.where(F.col("position") != ROWS)
    rows = evidence.where(F.col("position") == ROWS).agg(F.first("distinct_values")).scalar()
    counted = described(columns, ALL_MEASURES)
    nested = F.col("dtype").rlike("^(array|map|struct|variant)")
    unique = columns.select("position", F.when(~nested, F.coalesce(F.least("distinct_values", "non_null"), F.lit(0))).alias("unique_count"))
    return counted.join(F.broadcast(unique), "position").withColumn("duplicate_rows", F.greatest(F.col("row_count") - F.coalesce(rows, F.lit(0)), F.lit(0).cast("bigint")))


def _kinds() -> list[str]:
    from tablecare.functions import pii

    return list(pii.PATTERNS)


class PartProfiles:
    """States of the parts of a partitioned folder, kept in a table of their own.

    What a part's files are is known from their listing: names, sizes and times.
    A part with other files than when it was read is read again, one that is
    gone counts no longer.  Every run appends its states in one commit; two runs
    that read the same part leave equal states, of which one counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/states"

    def _stored(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, _STORED)

    def _latest(self) -> DataFrame:
        stored = self._stored()
        last = stored.groupBy("part").agg(F.max(F.struct("added", "run")).alias("l")).select("part", "l.added", "l.run")
        return stored.join(last, ["part", "added", "run"])

    def _files(self, folder: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)

    def listing(self, folder: str, column: str) -> DataFrame:
        """part, fingerprint, files, bytes and folders of a partitioned folder; no file is opened."""
        files = self._files(folder)
        one = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
        return files.groupBy(F.coalesce(F.col(quoted(column)).cast("string"), F.lit("")).alias("part")).agg(
            F.sum(one).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
            F.collect_set(F.regexp_replace("path", "/[^/]*$", "")).alias("folders"),
        )

    def add(self, folder: str, column: str, **options) -> list[str]:
        """Reads the parts that are new or changed and stores their states; returns their names."""
        listed = self.listing(folder, column).select("part", "fingerprint", "folders")
        known = self._latest().select("part", "fingerprint").distinct()
        # one name a folder, and the driver has listed the folders already
        differ = listed.join(known.withColumnRenamed("fingerprint", "before"), "part", "full").where(~F.col("fingerprint").eqNullSafe(F.col("before")))
        rows = differ.where("fingerprint IS NOT NULL OR before <> 'gone'").collect()
        new = {r["part"]: r["fingerprint"] for r in rows if r["fingerprint"] is not None}
        gone = [(r["part"], "gone") for r in rows if r["fingerprint"] is None]
        if not rows:
            return []
        states = self.spark.createDataFrame(gone, "part string, fingerprint string")
        if new:
            marks = F.broadcast(self.spark.createDataFrame(list(new.items()), "part string, fingerprint string"))
            folders = [f for r in rows if r["folders"] for f in r["folders"]]
            fresh = part_states(self._read(folder, column, folders), column, **options).join(marks, "part")
            states = fresh.unionByName(states, allowMissingColumns=True)
        stamped = states.withColumns({
            "added": F.unix_micros(F.current_timestamp()), "run": F.lit(uuid.uuid4().hex),
        })
        stamped.write.mode("append").parquet(self.path)
        return sorted(new)

    def _read(self, folder: str, column: str, folders: list[str]) -> DataFrame:
        """The rows of some parts, the column that names them read as in the whole folder."""
        reader = self.spark.read.option("basePath", folder)
        own, kind = reader.parquet(*folders).schema, self._files(folder).schema[column].dataType
        df = reader.schema(T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in own])).parquet(*folders)
        self._same_columns(df.drop(column))
        return df

    def _same_columns(self, df: DataFrame) -> None:
        known = {(r["position"], r["column"], r["dtype"]) for r in self._latest().where("position >= 0").select("position", "column", "dtype").distinct().collect()}
        own = {(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)}
        if known and known != own:
            raise ValueError(f"columns differ from those of stored parts: {sorted(known ^ own)}")

    def profile(self) -> DataFrame:
        """The profile of all parts, from their states alone."""
        return merged(self._latest().where("position IS NOT NULL").select(*_FIELDS))

    def parts(self) -> DataFrame:
        """part and row_count of the parts that count."""
        return self._latest().where(F.col("position") == ROWS).select("part", "row_count")
