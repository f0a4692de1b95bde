"""Order-dependent operators over keys of any size.

A window partitioned by the key alone puts a whole key in one task, and one key
may hold a third of the table.  Here rows are dealt out by ranges of key and
order columns, all of them, so that a large key is cut into chunks even where
its leading order values are equal; windows run within (key, chunk), and what a
chunk must know of the earlier ones is carried over from one summary row per
chunk.  Only a key at the edge of a chunk can lie in several, so the summary has
a few rows for each chunk, however many keys there are.  A table small enough
for one chunk needs no summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted
from tablecare.sources.session import cut_lineage

# Rows a chunk should hold at most.
ROWS_PER_CHUNK = 1_000_000
_CHUNK, _ORDER = "__chunk", "__order"


def _columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def _chunked(df: DataFrame, keys: list[str], order_by: list[str], chunks: int | None) -> tuple[DataFrame, int]:
    """Rows with their chunk and order, and the number of chunks.

    Ranges come from a sample, so the chunks are written out: all that reads
    them sees the same.
    """
    if chunks is None:
        chunks = -(-df.count() // ROWS_PER_CHUNK)
    if chunks <= 1:
        rows, chunks = df.withColumn(_CHUNK, F.lit(0)), 1
    else:
        dealt = df.repartitionByRange(chunks, *_columns([*keys, *order_by]))
        rows = cut_lineage(dealt.withColumn(_CHUNK, F.spark_partition_id()))
    return rows.withColumn(_ORDER, F.struct(*_columns(order_by))), chunks


def _within(keys: list[str]) -> Window:
    return Window.partitionBy(*_columns(keys), _CHUNK).orderBy(_ORDER)


def _matches(keys: list[str]) -> Column:
    """Equal keys, null keys among them; the other side's are __k0, __k1, ..."""
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition &= F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}"))
    return condition


def _spanning(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys that may lie in several chunks: the first and last of each."""
    key = F.struct(*[c.alias(f"__k{i}") for i, c in enumerate(_columns(keys))])
    edges = rows.groupBy(_CHUNK).agg(F.array(F.min(key), F.max(key)).alias("e"))
    edge_keys = edges.select(F.explode("e").alias("e")).select("e.*").distinct()
    return rows.join(edge_keys, _matches(keys), "left_semi")


def _attach(rows: DataFrame, summary: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Rows with what their chunk inherits; null keys meet null keys."""
    right = summary.select(*[c.alias(f"__k{i}") for i, c in enumerate(_columns(keys))], F.col(_CHUNK).alias("__kc"), *carried)
    return rows.join(right, (F.col(_CHUNK) == F.col("__kc")) & _matches(keys), "left")


def forward_fill(df: DataFrame, keys: list[str], order_by: list[str], columns: list[str],
                 chunks: int | None = None) -> DataFrame:
    """Nulls in `columns` replaced by the last earlier value of the same key."""
    rows, chunks = _chunked(df, keys, order_by, chunks)
    seen = _within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        *[
            F.last(F.col(quoted(c)), ignorenulls=True).over(seen).alias(c) if c in columns else F.col(quoted(c))
            for c in df.columns
        ],
        _CHUNK,
    )
    if chunks == 1:
        return local.drop(_CHUNK)
    before = Window.partitionBy(*_columns(keys)).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = _spanning(rows, keys).groupBy(*_columns(keys), _CHUNK).agg(*[
        F.max_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), F.col(_ORDER))).alias(f"__last{i}")
        for i, c in enumerate(columns)
    ])
    carried = [f"__carry{i}" for i in range(len(columns))]
    for i, name in enumerate(carried):
        summary = summary.withColumn(name, F.last(f"__last{i}", ignorenulls=True).over(before))
    filled = _attach(local, summary, keys, carried)
    return filled.select(*[
        F.coalesce(F.col(quoted(c)), F.col(carried[columns.index(c)])).alias(c)
        if c in columns else F.col(quoted(c))
        for c in df.columns
    ])


def with_previous(df: DataFrame, keys: list[str], order_by: list[str], column: str, alias: str,
                  chunks: int | None = None) -> DataFrame:
    """Adds the value `column` has in the row before, per key; null in its first row."""
    rows, chunks = _chunked(df, keys, order_by, chunks)
    window = _within(keys)
    local = rows.select(
        *_columns(df.columns), _CHUNK,
        F.lag(F.col(quoted(column))).over(window).alias(alias),
        F.row_number().over(window).alias("__rn"),
    )
    if chunks == 1:
        return local.drop(_CHUNK, "__rn")
    chunk_order = Window.partitionBy(*_columns(keys)).orderBy(_CHUNK)
    summary = _spanning(rows, keys).groupBy(*_columns(keys), _CHUNK).agg(F.max_by(F.col(quoted(column)), F.col(_ORDER)).alias("__last"))
    summary = summary.withColumn("__carry", F.lag("__last").over(chunk_order))
    out = _attach(local, summary, keys, ["__carry"])
    return out.select(*_columns(df.columns), F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col(alias)).alias(alias))


def with_position(df: DataFrame, keys: list[str], order_by: list[str], alias: str = "seq",
                  chunks: int | None = None) -> DataFrame:
    """Adds each row's position within its key, counted from 0."""
    rows, chunks = _chunked(df, keys, order_by, chunks)
    local = rows.select(*_columns(df.columns), _CHUNK, F.row_number().over(_within(keys)).alias("__rn"))
    if chunks == 1:
        return local.select(*_columns(df.columns), (F.col("__rn") - 1).cast("bigint").alias(alias))
    before = Window.partitionBy(*_columns(keys)).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = _spanning(rows, keys).groupBy(*_columns(keys), _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    summary = summary.withColumn("__carry", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = _attach(local, summary, keys, ["__carry"])
    return out.select(*_columns(df.columns), (F.coalesce("__carry", F.lit(0)) + F.col("__rn") - 1).cast("bigint").alias(alias))
