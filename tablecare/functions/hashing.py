"""Keys and fingerprints of values, rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# xxhash64 maps different values of these types to different hashes
_WORDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)

_JSON_OPTIONS = (
    "map('ignoreNullFields', 'false', 'timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\","
    " 'timestampNTZFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, NESTED)


def clean_sql(field: T.StructField) -> str:
    """The column with NaN read as null, the way missing numbers are counted."""
    c = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return f"nullif({c}, {field.dataType.simpleString()}('NaN'))"
    return c


def clean_value(field: T.StructField) -> Column:
    return F.expr(clean_sql(field))


def _hashable_sql(field: T.StructField) -> str:
    """A form of the column that xxhash64 separates by value."""
    if is_nested(field.dataType):
        # map entries and null elements do not reach xxhash64; their JSON text does
        c = quoted(field.name)
        return f"CASE WHEN {c} IS NOT NULL THEN to_json(struct({c} AS v), {_JSON_OPTIONS}) END"
    return clean_sql(field)


def key128_sql(columns: list[str]) -> tuple[str, str]:
    """128-bit key of the expressions: two independently seeded 64-bit hashes.

    Two longs travel through a shuffle in less space than a SHA-256 digest and
    need no text form of the values.  For n distinct inputs the chance of any
    collision is about n*n / 2**129 (1e-13 for 1e13 rows).
    """
    inside = ", ".join(columns)
    return f"xxhash64('a', {inside})", f"xxhash64('b', {inside})"


def value_key_sql(field: T.StructField) -> tuple[str, str]:
    """Both halves of the key of one value; null stays null."""
    c = _hashable_sql(field)
    halves = (f"xxhash64({c})", "0L") if isinstance(field.dataType, _WORDS) else key128_sql([c])
    return tuple(f"CASE WHEN {c} IS NOT NULL THEN {half} END" for half in halves)


def row_key_sql(schema: T.StructType) -> tuple[str, str]:
    """Both halves of the key of a whole row, null equal to null.

    xxhash64 passes over nulls, so each column is followed by its null flag;
    otherwise ('x', null) and (null, 'x') would meet.
    """
    return key128_sql([x for f in schema.fields for x in (_hashable_sql(f), f"{clean_sql(f)} IS NULL")])


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text form."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def row_fingerprint(columns: list[str], separator: str = "\x1f", null_text: str = "\x00") -> Column:
    """Short hash of a row's values in the given column order."""
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit(null_text)) for c in columns]
    return short_hash(F.concat_ws(separator, *parts))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (row_count, fingerprint), the same for any row order or partitioning.

    The fingerprint sums the row keys, so repeated rows count and no sort or
    shuffle of rows is needed.  Decimal sums hold any number of rows.
    """
    a, b = row_key_sql(df.schema)
    return df.selectExpr(
        "count(1) AS row_count",
        f"concat_ws('-', sum(CAST({a} AS decimal(20,0))), sum(CAST({b} AS decimal(20,0)))) AS fingerprint",
    )
