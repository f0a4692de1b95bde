"""What a repair changed, cell by cell, and the way back to the table as it came."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.sources.session import cut_lineage

#: Column under which removed repeats are listed.
WHOLE_ROW = "_all_"
#: Fixes that give missing cells a value; all others change cells that have one.
FILLS = "fill_"


@dataclass(frozen=True)
class PassLog:
    """Rows that one pass changed: `key`, `old` (the treated columns as they were), `cells` and `copies` removed."""

    rows: DataFrame
    #: Names and types before the pass, in order.
    columns: tuple[tuple[str, str], ...]
    treated: tuple[str, ...]


def repeated_keys(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key occurs more than once; rows that share one must be equal in all columns."""
    per_key = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(
        F.count("*").alias("__n"), F.min(F.xxhash64(*[F.col(quoted(c)) for c in df.columns])).alias("__low"),
        F.max(F.xxhash64(*[F.col(quoted(c)) for c in df.columns])).alias("__high"),
    )
    row = per_key.agg(F.max("__n").alias("most"), F.bool_or(F.col("__low") != F.col("__high")).alias("mixed")).first()
    if row["mixed"]:
        raise ValueError(f"different rows share a key {keys}; a change log needs keys that tell rows apart")
    return (row["most"] or 0) > 1


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(quoted(k)) for k in keys]).alias("key")


def _by_key(df: DataFrame, keys: list[str], columns: list[str], name: str, repeated: bool) -> DataFrame:
    """key, the columns as one struct, and how many equal rows there are."""
    rows = df.select(_key(keys), F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in columns]).alias(name))
    if not repeated:
        return rows.withColumn(f"n_{name}", F.lit(1).cast("bigint"))
    return rows.groupBy("key").agg(F.first(name).alias(name), F.count("*").alias(f"n_{name}"))


def log_pass(before: DataFrame, after: DataFrame, keys: list[str], fixes: dict[str, list[str]], repeated: bool) -> PassLog:
    """The rows a pass changed, from both tables joined by key.

    `fixes` has the fixes of each treated column; only those columns are read.
    A missing cell that got a value is put down to the filling fixes, any other
    changed cell to the rest.  Cells count as changed if their text differs.
    """
    treated = [c for c in before.columns if c in fixes]
    old = _by_key(before, keys, treated, "old", repeated)
    left = [c for c in treated if c in after.columns]
    new = _by_key(after, keys, left, "new", repeated).withColumnRenamed("key", "new_key")
    both = old.join(new, F.col("key").eqNullSafe(F.col("new_key")), "left")
    cells = []
    for c in treated:
        was = F.col(f"old.{quoted(c)}").cast("string")
        now = F.col(f"new.{quoted(c)}").cast("string") if c in left else F.lit(None).cast("string")
        fills = [f for f in fixes[c] if f.startswith(FILLS)]
        others = [f for f in fixes[c] if f not in fills]
        cause = F.when(was.isNull(), F.lit("+".join(fills or others))).otherwise(F.lit("+".join(others or fills)))
        cells.append(F.when(~was.eqNullSafe(now), F.struct(F.lit(c).alias("column"), was.alias("old"), now.alias("new"), cause.alias("fix"))))
    empty = F.array().cast("array<struct<column:string,old:string,new:string,fix:string>>")
    changed = F.array_compact(F.array(*cells)) if cells else empty
    rows = both.select("key", "old", changed.alias("cells"), (F.col("n_old") - F.coalesce("n_new", F.lit(0))).alias("copies"))
    return PassLog(cut_lineage(rows.where((F.size("cells") > 0) | (F.col("copies") > 0))), tuple((f.name, f.dataType.simpleString()) for f in before.schema.fields), tuple(treated))


def cells(logs: list[PassLog]) -> DataFrame:
    """iteration, key, column, old, new, fix and copies of every change; removed repeats as one row a key."""
    parts = []
    for i, log in enumerate(logs, 1):
        changed = log.rows.select(F.lit(i).alias("iteration"), "key", F.explode("cells").alias("c"), F.lit(0).cast("bigint").alias("copies"))
        parts.append(changed.select("iteration", "key", "c.column", "c.old", "c.new", "c.fix", "copies"))
        nothing = F.lit(None).cast("string")
        parts.append(log.rows.where("copies > 0").select(F.lit(i).alias("iteration"), "key", F.lit(WHOLE_ROW).alias("column"), nothing.alias("old"), nothing.alias("new"), F.lit("dedup_exact").alias("fix"), "copies"))
    return reduce(DataFrame.unionAll, parts)


def undo_pass(after: DataFrame, keys: list[str], log: PassLog) -> DataFrame:
    """The table before the pass: logged rows get their old cells and their repeats back, added columns go."""
    rows = after.select(_key(keys), F.struct(*[F.col(quoted(c)) for c in after.columns]).alias("now"))
    both = rows.join(log.rows.select(F.col("key").alias("logged"), "old", "copies"), F.col("key").eqNullSafe(F.col("logged")), "left")
    back = []
    for name, kind in log.columns:
        c = quoted(name)
        now = F.col(f"now.{c}").cast(kind) if name in after.columns else F.lit(None).cast(kind)
        back.append((F.when(F.col("logged").isNotNull(), F.col(f"old.{c}")).otherwise(now) if name in log.treated else now).alias(name))
    times = F.sequence(F.lit(0).cast("bigint"), F.coalesce("copies", F.lit(0)).cast("bigint"))
    return both.select(*back, F.explode(times).alias("__copy")).drop("__copy")
