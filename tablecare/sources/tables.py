"""Reading inputs and writing results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.functions.text import NA_TOKENS
from tablecare.operators.clean import keep_last, upsert

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?:inf|Inf|INF|infinity|Infinity)\s*$"
_BOOLEAN = r"^(?:True|TRUE|true|False|FALSE|false)$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _raw_csv(spark: SparkSession, path: str | list[str], separator: str, multi_line: bool, source: bool = False) -> DataFrame:
    """Fields as text, missing-value tokens as null; with `source` also the path of the file as `_file`."""
    raw = spark.read.csv(
        path, header=True, inferSchema=False, sep=separator, quote='"', escape='"',
        multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return raw.select(*[
        F.when(~F.col(quoted(c)).isin(NA_TOKENS), F.col(quoted(c))).alias(c) for c in raw.columns
    ], *([F.col("_metadata.file_path").alias("_file")] if source else []))


def _typed(c: Column, kind: str) -> Column:
    return F.trim(c).try_cast(kind)


def read_csv(spark: SparkSession, path: str, *, separator: str = ",", infer: bool = True,
             dates: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with a header, missing-value tokens as null and column types found from all values.

    Types are found in one scan after the tokens are set aside, so a token does
    not turn a number column into text.  `dates` also reads columns of
    yyyy-MM-dd as dates.  `multi_line` allows line breaks in quoted fields; such
    files cannot be split, so leave it off for large single files.
    """
    raw = _raw_csv(spark, path, separator, multi_line)
    if not infer or not raw.columns:
        return raw

    def fits(c: Column, pattern: str, kind: str) -> Column:
        return F.count_if(c.rlike(pattern) & _typed(c, kind).isNotNull())

    row = raw.agg(*[
        F.struct(
            F.count(c).alias("n"),
            fits(c, _INTEGER, "bigint").alias("bigint"),
            fits(c, _FLOAT, "double").alias("double"),
            fits(c, _BOOLEAN, "boolean").alias("boolean"),
            fits(c, _DATE, "date").alias("date"),
        ).alias(f"c{i}")
        for i, c in enumerate(F.col(quoted(c)) for c in raw.columns)
    ]).first()
    kinds = {}
    for i, name in enumerate(raw.columns):
        found = row[f"c{i}"]
        if found["n"] == 0:
            # an empty column reads as floating nulls
            kinds[name] = "double"
            continue
        for kind in ("bigint", "double", "boolean", "date"):
            if found[kind] == found["n"] and (kind != "date" or dates):
                kinds[name] = kind
                break
    return raw.select(*[
        _typed(F.col(quoted(c)), kinds[c]).alias(c) if c in kinds else F.col(quoted(c)) for c in raw.columns
    ])


def land(spark: SparkSession, path: str, run_id: str, **options) -> DataFrame:
    """CSV files of a landing folder with the file each row came from and the run id."""
    rows = _raw_csv(spark, path, options.get("separator", ","), options.get("multi_line", False))
    return rows.withColumn(
        "file_name", F.element_at(F.split(F.input_file_name(), "/"), -1)
    ).withColumn("run_id", F.lit(run_id))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def spread_out(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt out to all cores, ahead of costly expressions.

    A table with at least as many input splits as cores comes back as it is, so
    large tables are never moved.  Only for tables read straight from files:
    asking a plan with a shuffle for its splits would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _missing(error: AnalysisException) -> bool:
    """Whether nothing has been written yet; any other fault is the caller's to see."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Table at a path, or no rows where nothing has been written yet.

    JSON lines that don't fit the schema are left out here; ``json_rejects`` has them.
    """
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table at a path, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return None


def json_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON files that don't fit the schema, as ``line`` with their file."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("line"))
    read = F.from_json("line", f"{schema}, _rejected string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"})
    return lines.withColumn("r", read).where((F.trim("line") != "") & (F.col("r").isNull() | F.col("r._rejected").isNotNull())).drop("r")


def csv_rejects(spark: SparkSession, path: str, *, separator: str = ",", multi_line: bool = False) -> DataFrame:
    """Lines of CSV files with more or fewer fields than the header, as ``line`` with their file.

    ``read_csv`` keeps such rows, without the fields beyond the header and with
    nulls for missing ones.
    """
    names = _raw_csv(spark, path, separator, multi_line).columns
    schema = ", ".join(f"{quoted(c)} string" for c in names) + ", `_rejected` string"
    read = spark.read.schema(schema).csv(
        path, header=True, sep=separator, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_rejected",
    )
    named = read.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    # all columns stay in use: a pruned scan wouldn't count the fields
    whole = F.to_json(F.struct(*[F.col(quoted(c)) for c in names]))
    return named.where(F.col("_rejected").isNotNull() & (F.length(whole) > 0)).select("file_name", F.col("_rejected").alias("line"))


def read_checkpoint_json(spark: SparkSession, path: str) -> DataFrame:
    """Stage rows from JSON files that map a stage name to its state.

    Missing or unreadable files give no rows.
    """
    state = (
        "struct<status:string,started_at:string,completed_at:string,failed_at:string,"
        "output_hash:string,error:string,metadata:map<string,string>>"
    )
    entries = _whole_texts(spark, path).select("file_name", F.from_json("value", f"map<string,{state}>").alias("m"))
    return entries.select("file_name", F.explode("m").alias("stage", "s")).select("file_name", "stage", "s.*")


def read_watermark_json(spark: SparkSession, path: str) -> DataFrame:
    """Watermark rows from JSON files that map a source to its value."""
    entries = _whole_texts(spark, path).select(
        F.from_json("value", "map<string,struct<value:string,updated_at:string>>").alias("m")
    )
    return entries.select(F.explode("m").alias("source", "s")).select("source", "s.*")


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "file_name string, value string")
    return texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), "value")


# sinks

def write_table(df: DataFrame, target: str, *, fmt: str = "parquet", as_table: bool = False,
                partition_by: list[str] | None = None) -> None:
    """Replaces the target with the rows; the target must not be an input of df."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(target) if as_table else writer.save(target)


def write_json_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def upsert_table(spark: SparkSession, table: str, batch: DataFrame, keys: list[str],
                 order_by: list[str] | None = None) -> None:
    """Upserts a batch into a catalog table.

    The merged rows are written beside the table and take its place by a rename,
    so the table is never overwritten while being read and a failed run leaves
    it as it was.  A repeated run with the same batch gives the same table.
    """
    if not spark.catalog.tableExists(table):
        (keep_last(batch, keys, order_by) if order_by else batch).write.saveAsTable(table)
        return
    suffix = uuid.uuid4().hex[:8]
    merged, old = f"{table}_new_{suffix}", f"{table}_old_{suffix}"
    upsert(spark.table(table), batch, keys, order_by).write.saveAsTable(merged)
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {merged} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")


# sink inspection

def sink_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table and, as '_total_', of all together."""
    counts = reduce(DataFrame.unionAll, [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in tables.items()
    ])
    return counts.rollup("table_name").agg(F.sum("row_count").alias("row_count")).select(
        F.coalesce("table_name", F.lit("_total_")).alias("table_name"), "row_count"
    )


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Permanent tables of a database by name."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return {
        t.name: spark.table(f"{database}.{t.name}" if database else t.name)
        for t in listed if not t.isTemporary
    }


def sink_sample(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
