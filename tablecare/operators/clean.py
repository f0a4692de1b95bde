"""Deterministic cleaning transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.hashing import clean_value, key128_sql, quoted
from tablecare.functions.text import NA_TOKENS, numeric_text_to_double
from tablecare.operators.profile import profile_columns
from tablecare.operators.quantile import exact_medians, mode_rows
from tablecare.operators.rules import NULL_CRITICAL, OUTLIER_SIGMAS


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[
        new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns
    ])


# nulls

def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """Nulls in each named column replaced by its value."""
    return _replaced(df, {
        c: F.coalesce(clean_value(df.schema[c]), F.lit(v).cast(df.schema[c].dataType))
        for c, v in values.items()
    })


def _finite(field) -> Column:
    """The column's finite values as doubles, for statistics only."""
    v = clean_value(field).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _in_type(value: Column, field) -> Column:
    """A statistic in the column's own type, rounded where that is whole."""
    whole = isinstance(field.dataType, T.IntegralType)
    return (F.round(value) if whole else value).cast(field.dataType)


def fill_mean(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Nulls replaced by the mean of the finite values; the column keeps its type; all means in one scan."""
    means = df.agg(F.struct(*[
        F.round(F.avg(_finite(df.schema[c])), digits).alias(c) for c in columns
    ]).alias("m")).scalar()
    return _replaced(df, {
        c: F.coalesce(clean_value(df.schema[c]), _in_type(means[c], df.schema[c])) for c in columns
    })


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the exact column median; the column keeps its type; all medians from the same scans."""
    return _replaced(df, {
        c: F.coalesce(clean_value(df.schema[c]), _in_type(F.lit(m).cast("double"), df.schema[c]))
        for c, m in exact_medians(df, columns).items()
    })


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the most frequent value, the smallest among ties."""
    return _replaced(df, {
        c: F.coalesce(clean_value(df.schema[c]), mode_rows(df, c).select("value").scalar())
        for c in columns
    })


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every named column."""
    return df.na.drop(subset=[quoted(c) for c in columns])


def flag_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_was_null for each named column."""
    return df.select(
        "*", *[clean_value(df.schema[c]).isNull().alias(f"{c}_was_null") for c in columns]
    )


# columns

def drop_sparse_columns(df: DataFrame, above_percent: float = NULL_CRITICAL) -> DataFrame:
    """Table without the columns that are null in more than the given share of rows."""
    sparse = profile_columns(df, set()).filter(F.col("null_percent") > above_percent)
    return df.drop(*[r["column"] for r in sparse.select("column").collect()])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Table without the columns that hold exactly one distinct value."""
    constant = profile_columns(df, {"distinct"}).filter(F.col("unique_count") == 1)
    return df.drop(*[r["column"] for r in constant.select("column").collect()])


# duplicates

def dedup_exact(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; repeats collapse before the shuffle."""
    return df.dropDuplicates()


def _first_of(df: DataFrame, subset: list[str], order: list[Column]) -> DataFrame:
    """First row of each group of equal subset values.

    The filter on row_number lets Spark drop all but the first row of a group
    in every task before the shuffle, so copies of one row never pile up.  The
    hash leads the grouping so sorting seldom compares long texts.
    """
    parts = [x for c in subset for x in (quoted(c), f"{quoted(c)} IS NULL")]
    a, b = key128_sql(parts)
    keyed = df.selectExpr("*", f"{a} AS __a", f"{b} AS __b")
    window = Window.partitionBy("__a", "__b", *[F.col(quoted(c)) for c in subset]).orderBy(*order)
    return (
        keyed.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn", "__a", "__b")
    )


def dedup_keep_first(df: DataFrame, subset: list[str], order_by: list[str]) -> DataFrame:
    """First row, by the given order, of each set of rows equal on the subset."""
    return _first_of(df, subset, [F.col(quoted(o)) for o in order_by])


def keep_last(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Last row, by the given order, of each key."""
    return _first_of(df, keys, [F.col(quoted(o)).desc() for o in order_by])


# types

def _safe(c: str, to: str) -> Column:
    return numeric_text_to_double(c) if to == "double" else F.col(c).try_cast(to)


def safe_cast(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns cast to the given types; text that does not fit becomes null."""
    return _replaced(df, {c: _safe(quoted(c), t) for c, t in columns.items()})


def cast_rejects(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per column: values before the cast, and how many of them it rejects."""
    both = df.select(*[F.col(quoted(c)).alias(f"__{i}") for i, c in enumerate(columns)])
    new = {c: _safe(f"__{i}", t) for i, (c, t) in enumerate(columns.items())}
    rows = both.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count(f"__{i}").alias("values"),
            F.count_if(F.col(f"__{i}").isNotNull() & new[c].isNull()).alias("rejected"),
        )
        for i, c in enumerate(columns)
    ]).alias("r"))
    return rows.select(F.inline("r"))


#: Whole and decimal numbers without spare signs or zeros; a double holds fifteen digits of them.
_SPARE = r"^-?(0|[1-9][0-9]*)([.][0-9]*[1-9])?$"
_DIGITS = 15


def cast_losses(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per column: how many values a cast would lose or change.

    A value is kept if its text can be told from the new value: it is Spark's
    own text of that value, or, for doubles, a number of up to fifteen digits
    without spare signs, zeros or blanks.  One of both must fit all values of a
    column, so that different texts stay different values.  Texts that stand
    for a missing value become null and count as no loss.
    """
    both = df.select(*[F.col(quoted(c)).cast("string").alias(f"__{i}") for i, c in enumerate(columns)])
    counts = []
    for i, (c, t) in enumerate(columns.items()):
        text, new = F.col(f"__{i}"), _safe(f"__{i}", t)
        value = text.isNotNull() & ~F.trim(text).isin(NA_TOKENS)
        own = F.count_if(value & (new.isNull() | (new.cast("string") != text)))
        spare = text.rlike(_SPARE) & (text != "-0") & (F.length(F.regexp_replace(text, "[^0-9]", "")) <= _DIGITS)
        lost = F.least(own, F.count_if(value & ~spare)) if t == "double" else own
        counts.append(F.struct(F.lit(c).alias("column"), lost.alias("lost")))
    return both.agg(F.array(*counts).alias("r")).select(F.inline("r"))


# ranges

def outlier_bounds(df: DataFrame, columns: list[str], sigmas: float = OUTLIER_SIGMAS) -> dict[str, tuple[Column, Column]]:
    """Per column: mean less and plus the given number of sample deviations of its finite values, in one scan.

    Null where there are fewer than two finite values: then there are no bounds.
    """
    stats = df.agg(F.struct(*[
        F.struct(F.avg(v).alias("mean"), (sigmas * F.stddev_samp(v)).alias("reach")).alias(f"c{i}")
        for i, v in enumerate(_finite(df.schema[c]) for c in columns)
    ]).alias("s")).scalar()
    return {
        c: (stats[f"c{i}"]["mean"] - stats[f"c{i}"]["reach"], stats[f"c{i}"]["mean"] + stats[f"c{i}"]["reach"])
        for i, c in enumerate(columns)
    }


def _is_outlier(df: DataFrame, column: str, sigmas: float) -> Column:
    """Whether the value is outside the bounds; a null or NaN is not, an infinity is where there are bounds."""
    low, high = outlier_bounds(df, [column], sigmas)[column]
    v = clean_value(df.schema[column]).cast("double")
    return F.coalesce((v < low) | (v > high), F.lit(False))


def flag_outliers(df: DataFrame, column: str, sigmas: float = OUTLIER_SIGMAS,
                  alias: str | None = None) -> DataFrame:
    """Adds <column>_is_outlier; a null or NaN is no outlier."""
    return df.withColumn(alias or f"{column}_is_outlier", _is_outlier(df, column, sigmas))


def cap_outliers(df: DataFrame, columns: list[str], sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """Values outside the bounds moved to the nearer bound; columns keep their type, all bounds in one scan."""
    capped = {}
    for c, (low, high) in outlier_bounds(df, columns, sigmas).items():
        field, own = df.schema[c], F.col(quoted(c))
        v = clean_value(field).cast("double")
        # bounds of a whole-number column are the whole numbers inside them
        whole = isinstance(field.dataType, T.IntegralType)
        low, high = (F.ceil(low), F.floor(high)) if whole else (low, high)
        capped[c] = F.when(v < low, low.cast(field.dataType)).when(v > high, high.cast(field.dataType)).otherwise(own)
    return _replaced(df, capped)


def remove_outliers(df: DataFrame, column: str, sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """Rows whose value is inside the bounds, null or NaN."""
    return df.filter(~_is_outlier(df, column, sigmas))


def clip_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Negative values raised to zero; nulls stay."""
    return _replaced(df, {
        c: F.when(F.col(quoted(c)) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(quoted(c)))
        for c in columns
    })


# validation

class ConstraintError(Exception):
    """A table breaks constraints it must meet."""


def assert_constraints(df: DataFrame, constraints: dict[str, Column], min_rows: int = 0,
                       fail: bool = False) -> DataFrame:
    """Per constraint: whether it holds and how many rows break it, in one scan.

    A row breaks a constraint when its condition is false or null.  `min_rows`
    is checked as constraint "row_count", whose violating_rows are the rows
    missing.  With `fail` a broken constraint raises.
    """
    checks = [F.struct(
        F.lit("row_count").alias("constraint"),
        F.greatest(F.lit(min_rows) - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("violating_rows"),
    )]
    checks += [
        F.struct(
            F.lit(name).alias("constraint"),
            F.count_if(~F.coalesce(condition, F.lit(False))).alias("violating_rows"),
        )
        for name, condition in constraints.items()
    ]
    result = df.agg(F.array(*checks).alias("c")).select(F.inline("c")).select(
        "constraint", (F.col("violating_rows") == 0).alias("ok"), "violating_rows"
    )
    if fail:
        broken = [r["constraint"] for r in result.filter(~F.col("ok")).collect()]
        if broken:
            raise ConstraintError(", ".join(broken))
    return result


# upsert

def upsert(target: DataFrame, batch: DataFrame, keys: list[str],
           order_by: list[str] | None = None) -> DataFrame:
    """Target with the batch's rows added, replacing target rows of the same key.

    Running it again with the same batch changes nothing.  When the batch may
    repeat a key, `order_by` picks the last row; keys of the batch are otherwise
    taken to be unique.  Null keys match null keys.  Columns keep their order.
    """
    latest = keep_last(batch, keys, order_by) if order_by else batch
    new = latest.select(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = [F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return target.join(new, same, "left_anti").unionByName(latest)


# report

def revenue_by_region(lineitem: DataFrame, orders: DataFrame, customer: DataFrame,
                      nation: DataFrame, region: DataFrame) -> DataFrame:
    """Revenue per region of the buying customer.

    Revenue is added up per order, then per customer, then per nation before
    each join, so a hot order or customer reaches a join as one row.
    """
    by_order = lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    by_customer = (
        by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    )
    by_nation = (
        by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue"))
    )
    return (
        by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    )
