"""Column and table profiles.

A profile is a DataFrame with one row per profiled column, so its size is
bounded by the schema however large the table is.  Full-mode profiling reads
every column three times: in aggregations without a row shuffle for counts,
statistics and value evidence, and in shuffles of 128-bit keys, one for the
distinct counts of every few columns and one for duplicate rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions import pii
from tablecare.functions.hashing import (
    clean_sql, clean_value, is_nested, quoted, row_key_sql, value_key_sql,
)
from tablecare.functions.text import (
    date_formats_sql, date_like_sql, is_numeric_sql, iso_wall_time_sql, text_sql,
)
from tablecare.sources.session import cut_lineage

ALL_MEASURES = frozenset({"stats", "types", "distinct", "duplicates", "pii", "freshness"})

# How many leading non-null values stand for a column in sample mode.
SAMPLE_VALUES = 5
DATE_TRIAL_VALUES = 20

# Columns judged in one scan; a text column has one to itself: with the evidence of two, the code that Spark
# generates is too large for the JVM to compile, and every value takes several times as long.
SCAN_BUDGET = 12
TEXT_WEIGHT = 12
# Columns whose distinct values are found in one scan, so that a task's keys stay in its memory.
DISTINCT_COLUMNS = 4

# Distinct estimates at or above this share of the non-null count are counted exactly.
_NEAR_UNIQUE = 0.9
# Distinct estimates up to this too: values that share a register count as one.
_FEW = 16

def base_semantic_type(data_type: T.DataType) -> str:
    """Semantic type a storage type implies; text still needs its values judged."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "complex"


def head_rows(df: DataFrame, order_by: list[str], n: int = SAMPLE_VALUES) -> DataFrame:
    """First n rows by the given order as text, nulls shown as 'NULL'."""
    head = df.orderBy(*order_by).limit(n)
    return head.select(
        *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("NULL")).alias(c) for c in df.columns]
    )


def head_values(
    df: DataFrame, order_by: list[str], n: int = SAMPLE_VALUES, columns: list[str] | None = None
) -> DataFrame:
    """First n non-null values of each column as rows (column, position, value).

    Each column is a separate top-n over that column and the order key, so no
    rows are shuffled or sorted as a whole and only two columns are read at a time.
    """
    names = columns if columns is not None else df.columns
    fields = {f.name: f for f in df.schema.fields}
    order = [F.col(quoted(o)).alias(f"__o{i}") for i, o in enumerate(order_by)]
    keys = [f"__o{i}" for i in range(len(order_by))]
    parts = []
    for name in names:
        value = clean_value(fields[name])
        text = F.to_json(value) if is_nested(fields[name].dataType) else value.cast("string")
        parts.append(
            df.select(F.lit(name).alias("column"), text.alias("value"), *order)
            .filter(F.col("value").isNotNull())
            .orderBy(*keys)
            .limit(n)
        )
    union = reduce(DataFrame.unionAll, parts)
    first = Window.partitionBy("column").orderBy(*keys)
    return union.select("column", F.row_number().over(first).alias("position"), "value")


def _judged_sql(field: T.StructField, scan_all_types: bool) -> str | None:
    """The text in which a column's values are searched for personal data."""
    base = base_semantic_type(field.dataType)
    if base == "string":
        return quoted(field.name)
    if scan_all_types and base != "complex":
        return f"CAST({clean_sql(field)} AS string)"
    return None


def finite_sql(field: T.StructField) -> str:
    """A numeric column's finite values as doubles: an infinity shows in the extremes only."""
    number = f"CAST({clean_sql(field)} AS double)"
    if base_semantic_type(field.dataType) == "float":
        return f"CASE WHEN abs({number}) < double('Infinity') THEN {number} END"
    return number


def struct_sql(parts: dict[str, str]) -> str:
    return "struct(" + ", ".join(f"{sql} AS {name}" for name, sql in parts.items()) + ")"


def column_aggregates(position: int, field: T.StructField, measures: frozenset[str], full: bool,
                      exempt: set[str], scan_all_types: bool) -> dict[str, str]:
    """Aggregates over one column by name, the same names for all columns."""
    value, base = clean_sql(field), base_semantic_type(field.dataType)
    out = {
        "position": str(position),
        "column": text_sql(field.name),
        "dtype": text_sql(field.dataType.simpleString()),
        "base_type": f"'{base}'",
        "name_pii": "CAST(null AS string)",
        "row_count": "count(1)",
        "non_null": f"count({value})",
        "min": "CAST(null AS double)", "max": "CAST(null AS double)",
        "mean": "CAST(null AS double)", "std": "CAST(null AS double)",
        "text_values": "CAST(null AS bigint)", "numeric_values": "CAST(null AS bigint)",
        "date_fits": "CAST(null AS int)", "pii_hits": "CAST(null AS array<bigint>)",
        "latest": "CAST(null AS timestamp_ntz)",
    }
    if "stats" in measures and base in ("integer", "float"):
        finite = finite_sql(field)
        out |= {
            "min": f"CAST(min({value}) AS double)", "max": f"CAST(max({value}) AS double)",
            "mean": f"round(avg({finite}), 2)", "std": f"round(stddev_samp({finite}), 2)",
        }
    if full and base == "string":
        if "types" in measures:
            out |= {
                "text_values": f"count({value})",
                "numeric_values": f"count_if({is_numeric_sql(value)})",
                "date_fits": f"bit_and(__dates{position})",
            }
        if "freshness" in measures:
            out["latest"] = f"max({iso_wall_time_sql(f'__date{position}')})"
    if full and base == "datetime" and "freshness" in measures:
        out["latest"] = f"max(CAST({value} AS timestamp_ntz))"
    if "pii" in measures and field.name not in exempt:
        named = pii.name_type(field.name)
        if named:
            out["name_pii"] = f"'{named}'"
        elif full and _judged_sql(field, scan_all_types):
            hits = ", ".join(f"count_if(__pii{position} = '{name}')" for name in pii.PATTERNS)
            out["pii_hits"] = f"array({hits})"
    return out


def _scan_groups(schema: T.StructType, budget: int) -> list[list[tuple[int, T.StructField]]]:
    """Columns in groups whose total weight stays within the budget."""
    groups, weight = [], budget
    for position, field in enumerate(schema.fields):
        cost = TEXT_WEIGHT if base_semantic_type(field.dataType) == "string" else 1
        if weight + cost > budget:
            groups.append([])
            weight = 0
        groups[-1].append((position, field))
        weight += cost
    return groups


def scan_inputs(group: list[tuple[int, T.StructField]], measures: frozenset[str], full: bool,
                exempt: set[str], scan_all_types: bool) -> list[str]:
    """The columns of a scan, and what is worked out once per value for their aggregates."""
    needed = [quoted(f.name) for _, f in group]
    for position, field in group if full else ():
        judged = _judged_sql(field, scan_all_types)
        if "pii" in measures and judged and field.name not in exempt and not pii.name_type(field.name):
            needed.append(f"{pii.type_of_value_sql(judged)} AS __pii{position}")
        if base_semantic_type(field.dataType) == "string":
            if "types" in measures:
                needed.append(f"{date_formats_sql(quoted(field.name))} AS __dates{position}")
            if "freshness" in measures:
                needed.append(f"{date_like_sql(quoted(field.name))} AS __date{position}")
    return needed


def _scan(df: DataFrame, measures: frozenset[str], full: bool, exempt: set[str],
          scan_all_types: bool, scan_budget: int) -> DataFrame:
    """Evidence rows, one per column, from aggregations that shuffle one row per task.

    Columns are taken in groups: beyond a certain size the JVM no longer
    compiles the code Spark generates.  Each group reads only its own columns,
    so a columnar table is still read once in all.
    """
    parts = []
    for group in _scan_groups(df.schema, scan_budget):
        needed = scan_inputs(group, measures, full, exempt, scan_all_types)
        structs = [struct_sql(column_aggregates(i, f, measures, full, exempt, scan_all_types)) for i, f in group]
        one_row = df.selectExpr(*needed).selectExpr(f"array({', '.join(structs)}) AS columns")
        parts.append(one_row.selectExpr("inline(columns)"))
    return reduce(DataFrame.unionAll, parts)


def _sample_evidence(df: DataFrame, measures: frozenset[str], order_by: list[str],
                     exempt: set[str], scan_all_types: bool) -> DataFrame:
    """What the leading values of each column say about it."""
    judged = [
        text_sql(f.name) for f in df.schema.fields
        if "pii" in measures and f.name not in exempt and _judged_sql(f, scan_all_types)
    ]
    sample = f"position <= {SAMPLE_VALUES}"
    kind = f"CASE WHEN {sample} AND column IN ({', '.join(judged)}) THEN {pii.type_of_value_sql('value')} END"
    return (
        head_values(df, order_by, DATE_TRIAL_VALUES)
        .selectExpr("*", f"{kind if judged else 'CAST(null AS string)'} AS kind",
                    f"{date_formats_sql('value')} AS dates", f"{date_like_sql('value')} AS dated")
        .groupBy(F.col("column").alias("sampled"))
        .agg(
            F.expr(f"count_if({sample}) AS s_text"),
            F.expr(f"count_if({sample} AND {is_numeric_sql('value')}) AS s_numeric"),
            F.expr("count(1) AS s_trials"),
            F.expr("bit_and(dates) AS s_fits"),
            F.expr("min_by(kind, CASE WHEN kind IS NOT NULL THEN position END) AS s_pii"),
            F.expr(f"max(CASE WHEN {sample} THEN {iso_wall_time_sql('dated')} END) AS s_latest"),
        )
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None, rows: bool = True) -> DataFrame:
    """Distinct non-null values per column as (position, unique_count).

    With `rows`, position -1 carries the number of distinct whole rows.  Values
    shuffle as (position, 128-bit key) after map-side removal of repeats, so
    neither long texts nor a value held by most rows weigh on one task.  Whole
    rows and every few columns are removed of repeats apart: what a task holds
    stays small enough for its memory, and columns of few values don't share a
    large table of keys.
    """
    wanted = set(df.columns if columns is None else columns)
    keys = {
        i: value_key_sql(f) for i, f in enumerate(df.schema.fields)
        if f.name in wanted and not is_nested(f.dataType)
    }
    places = list(keys)
    groups = [places[k:k + DISTINCT_COLUMNS] for k in range(0, len(places), DISTINCT_COLUMNS)]
    if rows:
        keys[-1] = row_key_sql(df.schema)
        groups.append([-1])
    if not groups:
        return df.sparkSession.createDataFrame([], "position int, unique_count bigint")
    parts = []
    for group in groups:
        wide = df.selectExpr(*[f"{half} AS {name}" for i in group
                               for name, half in zip((f"`a{i}`", f"`b{i}`"), keys[i])])
        pairs = ", ".join(f"(`a{i}`, `b{i}`) AS `{i}`" for i in group)
        long = df.sparkSession.sql(
            f"SELECT CAST(position AS int) AS position, a, b FROM {{wide}} UNPIVOT ((a, b) FOR position IN ({pairs}))",
            wide=wide,
        )
        parts.append(long.distinct().groupBy("position").agg(F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionAll, parts)


def _approximate_counts(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Estimated distinct counts, and the columns whose estimate is small or near-unique.

    The rules compare counts with 1 and with the row count, so columns near
    either are left to an exact count; the estimate decides only far from both.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if not is_nested(f.dataType)]
    row = df.selectExpr(*[
        f"struct(approx_count_distinct({clean_sql(f)}, 0.02) AS n, count({clean_sql(f)}) AS non_null) AS c{i}"
        for i, f in fields
    ]).first()
    exact, estimates = [], []
    for i, f in fields:
        estimate = row[f"c{i}"]
        if estimate["n"] <= _FEW or estimate["n"] >= _NEAR_UNIQUE * estimate["non_null"]:
            exact.append(f.name)
        else:
            estimates.append((i, int(estimate["n"])))
    frame = df.sparkSession.createDataFrame(estimates, "position int, unique_count bigint")
    return frame, exact


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row on all columns, null equal to null."""
    return _row_groups(df).selectExpr("coalesce(sum(n - 1), 0L) AS duplicate_rows")


def _row_groups(df: DataFrame) -> DataFrame:
    """Per distinct row, how many rows equal it."""
    a, b = row_key_sql(df.schema)
    return df.selectExpr(f"{a} AS a", f"{b} AS b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )


def described(judged: DataFrame, measures: frozenset[str]) -> DataFrame:
    """The profile of columns, without distinct counts, from the evidence of their scan."""
    if "types" not in measures:
        semantic = "base_type"
    else:
        semantic = (
            "CASE WHEN base_type = 'string' AND (date_trials = 0 OR coalesce(date_fits, 0) <> 0)"
            " THEN 'datetime_string' ELSE base_type END"
        )
    # most frequent type wins; a tie goes to the earlier pattern
    ranked = ", ".join(
        f"struct(get(pii_hits, {i}) AS hits, {-i} AS rank, '{name}' AS kind)"
        for i, name in enumerate(pii.PATTERNS)
    )
    best = f"array_max(array({ranked}))"
    value_pii = f"coalesce(first_pii, CASE WHEN {best}.hits > 0 THEN {best}.kind END)"
    return judged.selectExpr(
        "position", "column", "dtype", f"{semantic} AS semantic_type", "row_count",
        "row_count - non_null AS null_count",
        "round(try_divide((row_count - non_null) * 100.0D, row_count), 2) AS null_percent",
        "min", "max", "mean", "std", "text_values", "numeric_values",
        f"coalesce(name_pii, {value_pii}) AS pii_type",
        "CASE WHEN name_pii IS NOT NULL THEN 'column_name_match'"
        f" WHEN {value_pii} IS NOT NULL THEN 'value_pattern_match' END AS pii_method",
        "latest",
    )


def profile_columns(
    df: DataFrame,
    measures: frozenset[str] | set[str] = ALL_MEASURES,
    *,
    mode: str = "full",
    order_by: list[str] | None = None,
    approx: bool = False,
    scan_all_types: bool = False,
    pii_exempt: list[str] | tuple[str, ...] = (),
    scan_budget: int = SCAN_BUDGET,
    materialize: bool = False,
) -> DataFrame:
    """One row per column: counts, statistics and the evidence the rules need.

    mode "full" judges text by all its values; "sample" by the leading values
    in `order_by`, which it requires.  `approx` estimates distinct counts that
    are neither small nor near unique.  `scan_all_types` searches numbers and dates for
    personal data too.  `pii_exempt` names columns already made safe.
    `scan_budget` sets how many columns share a scan; raise it for row-oriented
    files, which every scan reads whole.  `materialize` writes the input to the
    shared folder first: for derived inputs, which each scan would work out again.
    Measures left out come back null.
    """
    if materialize:
        df = cut_lineage(df)
    measures = frozenset(measures)
    full = mode == "full"
    if mode not in ("full", "sample"):
        raise ValueError(f"unknown mode {mode!r}")
    if not full and not order_by:
        raise ValueError("sample mode needs order_by: rows of a table have no order of their own")
    scan = _scan(df, measures, full, set(pii_exempt), scan_all_types, scan_budget)

    if full or not measures & {"types", "pii", "freshness"}:
        judged = scan.selectExpr(
            "*", "non_null AS date_trials", "CAST(null AS string) AS first_pii"
        )
    else:
        sample = _sample_evidence(df, measures, order_by, set(pii_exempt), scan_all_types)
        replaced = ["text_values", "numeric_values", "date_fits", "latest"]
        # one row per column: bounded by the schema
        judged = scan.drop(*replaced).join(
            F.broadcast(sample), F.col("column") == F.col("sampled"), "left"
        ).selectExpr(
            "*", "coalesce(s_text, 0L) AS text_values", "coalesce(s_numeric, 0L) AS numeric_values",
            "coalesce(s_trials, 0L) AS date_trials", "s_fits AS date_fits", "s_pii AS first_pii",
            "s_latest AS latest",
        )
    out = described(judged, measures)

    rows = "duplicates" in measures
    if not rows and "distinct" not in measures:
        return out.selectExpr(
            "*", "CAST(null AS bigint) AS unique_count", "CAST(null AS bigint) AS duplicate_rows"
        )
    if "distinct" not in measures:
        counts = distinct_counts(df, [], rows)
    elif approx:
        counts, near_unique = _approximate_counts(df)
        if near_unique or rows:
            counts = counts.unionByName(distinct_counts(df, near_unique, rows))
    else:
        counts = distinct_counts(df, None, rows)
    # a map of at most one entry per column, read back as a one-row subquery
    by_position = counts.selectExpr(
        "map_from_entries(collect_list(struct(position, unique_count))) AS m"
    ).scalar()
    unique = (
        "CASE WHEN dtype NOT RLIKE '^(array|map|struct|variant)'"
        " THEN coalesce(try_element_at(__counts, position), 0L) END"
        if "distinct" in measures else "CAST(null AS bigint)"
    )
    repeated = (
        "row_count - coalesce(try_element_at(__counts, -1), 0L)" if rows else "CAST(null AS bigint)"
    )
    return out.withColumn("__counts", by_position).selectExpr(
        *out.columns, f"{unique} AS unique_count", f"{repeated} AS duplicate_rows"
    )


def profile_table(df: DataFrame, file_name: str = "") -> DataFrame:
    """One row: name, row count, column count and repeated rows of a table."""
    return _row_groups(df).selectExpr(
        f"{text_sql(file_name)} AS file_name",
        "coalesce(sum(n), 0L) AS row_count",
        f"{len(df.columns)}L AS column_count",
        "coalesce(sum(n - 1), 0L) AS duplicate_rows",
    )
