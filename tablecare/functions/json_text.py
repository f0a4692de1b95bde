"""Tolerant extraction of JSON fields from raw response text.

A response is a JSON object, possibly inside other text or a code block, and
possibly cut short or malformed.  Where some stretch from a '{' to a '}' parses,
its fields are taken.  Otherwise a key is located by its place in the text and
its value read up to the quote that closes it, or to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted

# Stand-ins, while a value's end is looked for, for an escaped backslash and an escaped quote.
_BACKSLASH, _QUOTE = "chr(1)", "chr(2)"
# Characters as SQL, none of which needs escaping in a literal.
_SLASH, _MARK = "chr(92)", "chr(34)"


def _parsed(text: str) -> str:
    """A variant where the text is one JSON object, else null."""
    return f"CASE WHEN startswith(trim(BOTH ' \\n\\r\\t' FROM {text}), '{{') THEN try_parse_json({text}) END"


def _between(text: str, start: str) -> str:
    """From the first '{' at or after a place to the last '}'."""
    opened = f"locate('{{', {text}, greatest({start}, 1))"
    after_last = f"length({text}) - instr(reverse({text}), '}}') + 2"
    return f"CASE WHEN {opened} > 0 AND instr({text}, '}}') > 0 THEN substring({text}, {opened}, greatest({after_last} - {opened}, 0)) END"


def object_of_sql(raw: str) -> str:
    """The object that the whole text is, or that stands in a code block or anywhere in it."""
    fenced = f"CASE WHEN contains({raw}, '```') THEN substring_index(substring({raw}, instr({raw}, '```') + 3), '```', 1) END"
    candidates = [raw, _between(fenced, "1"), _between(raw, "1")]
    return f"coalesce({', '.join(_parsed(c) for c in candidates)})"


def _decoded(value: str) -> str:
    """A string value as its escapes say, with the line breaks and tabs it may hold as they are; else unchanged."""
    lines = f"replace(replace(replace({value}, chr(10), {_SLASH} || 'n'), chr(13), {_SLASH} || 'r'), chr(9), {_SLASH} || 't')"
    return f"trim(coalesce(try_variant_get(try_parse_json({_MARK} || {lines} || {_MARK}), '$', 'string'), {value}))"


def field_by_key_sql(raw: str, key: str) -> str:
    """Value of a key found by its place, in text that holds no valid object."""
    name = f"{_MARK} || '{key}' || {_MARK}"
    rest = f"ltrim(substring({raw}, instr({raw}, {name}) + length({name})))"
    value = f"ltrim(substring({rest}, 2))"
    hidden = f"replace(replace(substring({value}, 2), {_SLASH} || {_SLASH}, {_BACKSLASH}), {_SLASH} || {_MARK}, {_QUOTE})"
    text = f"substring_index({hidden}, {_MARK}, 1)"
    shown = f"replace(replace({text}, {_QUOTE}, {_SLASH} || {_MARK}), {_BACKSLASH}, {_SLASH} || {_SLASH})"
    bare = f"regexp_extract({value}, '^(-?[0-9][0-9.eE+-]*|true|false)', 1)"
    return (
        f"CASE WHEN instr({raw}, {name}) = 0 OR NOT startswith({rest}, ':') THEN NULL"
        f" WHEN startswith({value}, {_MARK}) THEN {_decoded(shown)} ELSE nullif({bare}, '') END"
    )


def salvage_fields(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Adds one text column per key of a JSON object that may be wrapped or broken.

    The object is parsed once per row; only where no valid object is found are
    the keys looked up one by one.  Null text gives nulls.
    """
    parsed = df.withColumn("__object", F.expr(object_of_sql(quoted(raw))))
    fields = [
        f"CASE WHEN __object IS NOT NULL THEN try_variant_get(__object, \"$['{k}']\", 'string')"
        f" ELSE {field_by_key_sql(quoted(raw), k)} END AS {quoted(k)}"
        for k in keys
    ]
    return parsed.selectExpr(*[quoted(x) for x in df.columns], *fields)
