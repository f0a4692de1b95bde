"""Personal data in documents, pages and customer contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions import pii
from tablecare.functions.text import pattern_sql
from tablecare.operators import personal, profile, rules
from tablecare.plans.catalog import query
from tablecare.plans.relations import CONTACTS_SQL, contacts, spread_table, table

_PATTERNS = pii.PATTERNS


def _type_sql(c: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in _PATTERNS.items())
    return f"CASE {cases} END"


# columns searched: (table, column, announced type)
_SEARCHED = [
    ("documents", "text", None), ("documents", "lang", None), ("documents", "source", None),
    ("pages", "url", None), ("pages", "html", None),
    ("conversations", "role", None), ("conversations", "text", None),
    ("contacts", "last_login_from", None),
]
_NAMED = {"full_name": "personal_name", "email": "email", "phone": "phone", "card_number": "credit_card",
          "dob": "date_of_birth", "address": "address"}


def _best_sql(name: str, column: str) -> str:
    """Most frequent type among a column's values, ties to the earlier pattern."""
    return f"""
SELECT * FROM (
  SELECT '{name}' AS table_name, '{column}' AS "column", kind AS type, 'value_pattern_match' AS detection_method
  FROM (SELECT {_type_sql(column)} AS kind FROM {name}) WHERE kind IS NOT NULL GROUP BY kind
  ORDER BY count(*) DESC, list_position({list(_PATTERNS)}, kind) LIMIT 1)
"""


_DETECTED_SQL = f"""
WITH {CONTACTS_SQL}, detected AS (
{" UNION ALL ".join(_best_sql(t, c) for t, c, _ in _SEARCHED)}
{" ".join(f"UNION ALL SELECT 'contacts', '{c}', '{t}', 'column_name_match'" for c, t in _NAMED.items())})
"""


def _sources(spark, folder) -> dict[str, DataFrame]:
    found = {n: spread_table(spark, folder, n) for n in ("documents", "pages", "conversations")}
    found["contacts"] = contacts(spark, folder)
    return found


def _detected(spark, folder) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        personal.detect_pii(df).select(F.lit(name).alias("table_name"), "*")
        for name, df in _sources(spark, folder).items()
    ])


@query("pii_columns", f"{_DETECTED_SQL} SELECT * FROM detected")
def pii_columns(spark, folder) -> DataFrame:
    return _detected(spark, folder).select("table_name", "column", "type", "detection_method")


_ADVICE = ", ".join(f"('{k}', '{v}')" for k, v in pii.REMEDIATION.items())


@query("pii_remediation", f"""
{_DETECTED_SQL}, advice(type, remediation) AS (VALUES {_ADVICE})
SELECT table_name, "column", type, coalesce(remediation, '{pii.DEFAULT_REMEDIATION}') AS remediation
FROM detected LEFT JOIN advice USING (type)
""")
def pii_remediation(spark, folder) -> DataFrame:
    return _detected(spark, folder).select("table_name", "column", "type", "remediation")


@query("rule_pii", f"""
{_DETECTED_SQL}, advice(type, remediation) AS (VALUES {_ADVICE})
SELECT table_name, "column", 'critical' AS severity, CAST(10 AS BIGINT) AS points,
       'Potential PII detected in ''' || "column" || ''': ' || type AS description,
       'Apply ' || remediation || ' before storing in data warehouse' AS recommendation
FROM detected JOIN advice USING (type)
""")
def rule_pii(spark, folder) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        rules.check(profile.profile_columns(df, rules.MEASURES["pii_detected"]))
        .select(F.lit(name).alias("table_name"), "column", "severity", "points", "description", "recommendation")
        for name, df in _sources(spark, folder).items()
    ]).filter(F.col("description").startswith("Potential PII"))


def _sample_sql(name: str, column: str, key: str) -> str:
    return f"""
SELECT '{name}' AS table_name, '{column}' AS "column", first(kind ORDER BY {key}) AS type FROM (
  SELECT {key}, {_type_sql(column)} AS kind FROM (
    SELECT {key}, {column} FROM {name} WHERE {column} IS NOT NULL ORDER BY {key} LIMIT 5))
WHERE kind IS NOT NULL HAVING count(*) > 0
"""


@query("pii_columns_sampled", f"""
WITH {CONTACTS_SQL}, unnamed AS (SELECT c_custkey, email AS a, phone AS b, last_login_from AS c, address AS d FROM contacts)
{" UNION ALL ".join([*(_sample_sql("unnamed", c, "c_custkey") for c in "abcd"),
                     _sample_sql("documents", "text", "doc_id"), _sample_sql("documents", "lang", "doc_id"),
                     _sample_sql("documents", "source", "doc_id"), _sample_sql("pages", "url", "page_id"),
                     _sample_sql("pages", "html", "page_id")])}
""")
def pii_columns_sampled(spark, folder) -> DataFrame:
    parts = [
        personal.detect_pii(table(spark, folder, name), mode="sample", order_by=[key])
        .select(F.lit(name).alias("table_name"), "column", "type")
        for name, key in (("documents", "doc_id"), ("pages", "page_id"))
    ]
    unnamed = contacts(spark, folder).selectExpr("c_custkey", "email AS a", "phone AS b", "last_login_from AS c", "address AS d")
    sampled = personal.detect_pii(unnamed, mode="sample", order_by=["c_custkey"]).select(F.lit("unnamed").alias("table_name"), "column", "type")
    return parts[0].unionAll(parts[1]).unionAll(sampled)


@query("pii_by_name", f"""
WITH {CONTACTS_SQL}
{" UNION ALL ".join(f"SELECT '{c}' AS column, '{t}' AS type, count({c}) AS values_exposed FROM contacts" for c, t in _NAMED.items())}
""".replace("AS column", 'AS "column"'))
def pii_by_name(spark, folder) -> DataFrame:
    return personal.named_pii(contacts(spark, folder))


# matches in text

def _register_matches(name: str, kind: str) -> None:
    pattern = _PATTERNS[kind]

    @query(name, f"""
SELECT 'documents' AS table_name, doc_id AS id, len(regexp_extract_all(text, '{pattern}')) AS matches,
       regexp_extract(text, '{pattern}') AS first_match
FROM documents WHERE regexp_matches(text, '{pattern}')
UNION ALL
SELECT 'pages', page_id, len(regexp_extract_all(html, '{pattern}')), regexp_extract(html, '{pattern}')
FROM pages WHERE regexp_matches(html, '{pattern}')
UNION ALL
SELECT 'customer', c_custkey, len(regexp_extract_all(note, '{pattern}')), regexp_extract(note, '{pattern}')
FROM (SELECT c_custkey, c_name || ' ' || (c_custkey % 899 + 100) || '-' || (c_custkey % 90 + 10) || '-' || (c_custkey % 9000 + 1000) AS note FROM customer)
WHERE regexp_matches(note, '{pattern}')
""")
    def run(spark, folder) -> DataFrame:
        def found(df: DataFrame, label: str, key: str, text: str) -> DataFrame:
            return df.filter(pii.matches(text, kind)).selectExpr(
                f"'{label}' AS table_name", f"{key} AS id",
                f"CAST(regexp_count({text}, {pattern_sql(pattern)}) AS bigint) AS matches",
                f"regexp_extract({text}, {pattern_sql(pattern)}, 0) AS first_match",
            )

        noted = table(spark, folder, "customer").selectExpr(
            "c_custkey", "concat(c_name, ' ', c_custkey % 899 + 100, '-', c_custkey % 90 + 10, '-', c_custkey % 9000 + 1000) AS note"
        )
        return found(table(spark, folder, "documents"), "documents", "doc_id", "text").unionAll(
            found(table(spark, folder, "pages"), "pages", "page_id", "html")
        ).unionAll(found(noted, "customer", "c_custkey", "note"))


for _name, _kind in {
    "pii_email_docs": "email", "pii_phone_docs": "phone", "pii_ssn_docs": "ssn",
    "pii_card_docs": "credit_card", "pii_ip_docs": "ip_address",
}.items():
    _register_matches(_name, _kind)


@query("pii_row_type", f"SELECT doc_id, coalesce({_type_sql('text')}, 'none') AS pii_type FROM documents")
def pii_row_type(spark, folder) -> DataFrame:
    return spread_table(spark, folder, "documents").select(
        "doc_id", F.coalesce(pii.type_of_value("text"), F.lit("none")).alias("pii_type")
    )


def _redact_sql(c: str) -> str:
    for name in pii.REDACTED:
        pattern = _PATTERNS[name] + ("[0-9]*" if name == "phone" else "")
        c = f"regexp_replace({c}, '{pattern}', '[{name}]', 'g')"
    return c


def _redacted(name: str, key: list[str], text: str) -> None:
    """Registers the redaction of a whole table's text column."""
    keys = ", ".join(key)
    sql = f"""
SELECT {keys}, sha256(redacted) AS redacted_sha, redacted <> {text} AS changed
FROM (SELECT *, {_redact_sql(text)} AS redacted FROM {name})
"""

    @query({"documents": "pii_redact_docs"}.get(name, f"pii_redact_{name}"), sql)
    def redacted(spark, folder) -> DataFrame:
        rows = spread_table(spark, folder, name).select(*key, text, F.col(text).alias("r"))
        return pii.redact(rows, ["r"]).select(*key, F.sha2("r", 256).alias("redacted_sha"), (F.col("r") != F.col(text)).alias("changed"))


_redacted("documents", ["doc_id"], "text")
_redacted("pages", ["page_id"], "html")
_redacted("conversations", ["conv_id", "turn"], "text")


@query("pii_anonymize_ip", r"""
SELECT doc_id, sha256(regexp_replace(text, '\b((?:\d{1,3}\.){3})\d{1,3}\b', '\10', 'g')) AS anonymized_sha
FROM documents
""")
def pii_anonymize_ip(spark, folder) -> DataFrame:
    return spread_table(spark, folder, "documents").select(
        "doc_id", F.sha2(pii.anonymize_ip(F.col("text")), 256).alias("anonymized_sha")
    )


def _matches_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS id, '{kind}' AS kind, unnest(regexp_extract_all({text}, '{pattern}')) AS value FROM {name}"
        for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
        for kind, pattern in _PATTERNS.items()
    )


def _matches(spark, folder) -> DataFrame:
    return personal.pii_matches(spread_table(spark, folder, "documents"), "doc_id", "text").unionAll(
        personal.pii_matches(spread_table(spark, folder, "pages"), "page_id", "html")
    )


@query("pii_mask", f"""
WITH found AS ({_matches_sql()})
SELECT id, kind, CASE
         WHEN kind = 'email' AND len(string_split(value, '@')) = 2
           THEN left(string_split(value, '@')[1], 2) || '***@' || string_split(value, '@')[2]
         WHEN length(value) > 4 THEN left(value, 2) || repeat('*', length(value) - 4) || right(value, 2)
         ELSE '***' END AS masked
FROM found
""")
def pii_mask(spark, folder) -> DataFrame:
    return _matches(spark, folder).select(
        "id", "kind", pii.mask(F.col("value"), F.col("kind")).alias("masked")
    )


@query("pii_hash", f"""
WITH found AS ({_matches_sql()})
SELECT id, kind, substring(sha256(value), 1, 16) AS pseudonym, substring(sha256('pepper' || value), 1, 16) AS salted
FROM found
""")
def pii_hash(spark, folder) -> DataFrame:
    return _matches(spark, folder).select(
        "id", "kind", pii.hash_value(F.col("value")).alias("pseudonym"),
        pii.hash_value(F.col("value"), salt="pepper").alias("salted"),
    )


@query("pii_remediate", f"""
WITH {CONTACTS_SQL}
SELECT c_custkey, substring(sha256(full_name), 1, 16) AS full_name, substring(sha256(email), 1, 16) AS email,
       '***-***-' || right(phone, 4) AS phone, '****-****-****-' || right(card_number, 4) AS card_number,
       CAST(left(dob, 4) AS INTEGER) AS dob,
       regexp_replace(last_login_from, '\\.\\d+$', '.0') AS last_login_from,
       CASE WHEN length(address) > 4 THEN left(address, 2) || repeat('*', length(address) - 4) || right(address, 2)
            ELSE '***' END AS address
FROM contacts
""")
def pii_remediate(spark, folder) -> DataFrame:
    df = contacts(spark, folder)
    # the detection is bounded by the columns of the table
    types = {r["column"]: r["type"] for r in personal.detect_pii(df).collect()}
    return personal.remedy_columns(df, types)
