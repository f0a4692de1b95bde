"""Recognisers for numbers and dates held as text.

Functions ending in _sql take and return SQL expression text, so that a profile
of many columns is parsed once; the others take a column name or expression
text and return a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One numeric literal as a lenient float parser reads it, once single underscores
# between digits are gone: infinities and nan count, blanks are trimmed.  Plain
# classes only: a repeated group makes the JVM recurse once a digit, and a few
# thousand digits would end the session.
NUMERIC_PATTERN = (
    r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)
_JOINED = r"(?<=[0-9])_(?=[0-9])"

# Texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Forms of text dates, each with the ISO readings it is tried as.
# A column is a date column only when one reading of one form fits every value.
# {c} is the text; readings use substrings because the forms have fixed widths.
DATE_FORMS = [
    (r"^\d{4}-\d{2}-\d{2}$", ["{c}"]),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", ["{c}"]),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", ["{c}"]),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$", ["{c}"]),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d{1,6}(?:Z|[+-]\d{2}:\d{2})?$", ["{c}"]),
    (r"^\d{4}/\d{2}/\d{2}$", ["replace({c}, '/', '-')"]),
    (r"^\d{2}/\d{2}/\d{4}$", [
        "concat_ws('-', right({c}, 4), left({c}, 2), substring({c}, 4, 2))",
        "concat_ws('-', right({c}, 4), substring({c}, 4, 2), left({c}, 2))",
    ]),
    (r"^\d{2}-\d{2}-\d{4}$", ["concat_ws('-', right({c}, 4), substring({c}, 4, 2), left({c}, 2))"]),
]

# ISO 8601 text; the zone is captured apart because freshness compares wall time.
_ISO_WALL = (
    r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)"
    r"(?:Z|[+-]\d{2}:?\d{2})?$"
)
_ISO_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"


def pattern_sql(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    return f'r"{pattern}"'


def text_sql(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_numeric_sql(c: str) -> str:
    """True when the text reads as one number.

    The pattern is only tried on text whose ends could be those of a number:
    a failing search walks the whole text, even with an anchored pattern.
    """
    trimmed = f"trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM {c})"
    plain = f"CASE WHEN contains({c}, '_') THEN regexp_replace({c}, {pattern_sql(_JOINED)}, '') ELSE {c} END"
    return (
        f"(instr('0123456789+-.iInN', left({trimmed}, 1)) > 0"
        f" AND right({trimmed}, 2) RLIKE {pattern_sql(r'(?:[0-9][.]?|[fFyYnN])$')}"
        f" AND {plain} RLIKE {pattern_sql(NUMERIC_PATTERN)})"
    )


def date_like_sql(c: str) -> str:
    """The text where it may start with two digits, as every date form does, else null."""
    return f"CASE WHEN left({c}, 2) BETWEEN '00' AND '99' THEN {c} END"


def date_formats_sql(c: str) -> str:
    """Bit mask of the date readings the text allows; null for null.

    The bitwise AND over a column tells which readings fit all its values.
    """
    bit, cases = 1, []
    for shape, readings in DATE_FORMS:
        masks = []
        for reading in readings:
            masks.append(f"CASE WHEN try_cast({reading.format(c=c)} AS timestamp) IS NOT NULL THEN {bit} ELSE 0 END")
            bit *= 2
        cases.append(f"WHEN {c} RLIKE {pattern_sql(shape)} THEN {' | '.join(masks)}")
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {date_like_sql(c)} IS NULL THEN 0 {' '.join(cases)} ELSE 0 END"
    )


def iso_wall_time_sql(c: str) -> str:
    """ISO 8601 text as a zoneless timestamp, the zone dropped unconverted; else null."""
    wall, compact = pattern_sql(_ISO_WALL), pattern_sql(_ISO_COMPACT)
    return (
        f"CASE WHEN {c} RLIKE {wall} THEN try_cast(regexp_extract({c}, {wall}, 1) AS timestamp_ntz)"
        f" WHEN {c} RLIKE {compact}"
        f" THEN try_cast(regexp_replace({c}, {compact}, '$1-$2-$3') AS timestamp_ntz) END"
    )


def is_numeric_text(c: str) -> Column:
    return F.expr(is_numeric_sql(c))


def numeric_text_to_double(c: str) -> Column:
    """The number a text holds, or null; never throws."""
    return F.expr(f"CASE WHEN {is_numeric_sql(c)} THEN try_cast(replace(trim({c}), '_', '') AS double) END")


def iso_wall_time(c: str) -> Column:
    return F.expr(iso_wall_time_sql(c))
