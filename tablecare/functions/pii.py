"""Personal-data recognisers and remedies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.hashing import quoted, short_hash
from tablecare.functions.text import pattern_sql, text_sql

# Patterns, in the order in which they take precedence.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# Searches for an email that take time in proportion to the text.  Whether there
# is one shows beside the '@' already; for its span the search starts at the head
# of a run of name characters or where the last match ended.
_EMAIL_TEST = r"[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_EMAIL_SPAN = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TESTS = PATTERNS | {"email": _EMAIL_TEST}
SPANS = PATTERNS | {"email": _EMAIL_SPAN}

# Order of redaction: longer and bounded digit forms before phone numbers, whose
# pattern would take a part of them; a phone number takes all digits that follow.
REDACTED = ["email", "credit_card", "ssn", "ip_address", "phone"]

# Column names that mark personal data, by type.
NAMES = {
    "email": ["email", "e_mail", "email_address", "mail"],
    "phone": ["phone", "phone_number", "mobile", "cell", "telephone"],
    "ssn": ["ssn", "social_security", "social_security_number"],
    "credit_card": ["credit_card", "card_number", "cc_number", "card_num"],
    "personal_name": ["name", "first_name", "last_name", "full_name"],
    "address": ["address", "street_address", "home_address"],
    "date_of_birth": ["dob", "date_of_birth", "birth_date", "birthday"],
    "financial": ["salary", "income", "wage"],
    "potential_pii": ["passport", "passport_number", "driver_license"],
}

# Advice per type.
REMEDIATION = {
    "email": "hash or tokenize (SHA-256 pseudonymization)",
    "phone": "mask (show last 4 digits only)",
    "ssn": "encrypt at rest (AES-256) and mask in transit",
    "credit_card": "tokenize via PCI-DSS compliant vault",
    "personal_name": "pseudonymize or remove if not needed",
    "address": "generalize to city/region level",
    "date_of_birth": "generalize to age range or birth year",
    "ip_address": "anonymize (zero last octet)",
    "financial": "encrypt at rest and restrict access via IAM",
    "potential_pii": "review and apply appropriate masking/encryption",
}
DEFAULT_REMEDIATION = "apply appropriate data protection"

# A necessary condition of a match that is cheaper to test than its pattern.
_NEEDS = {
    "email": "contains({c}, '@') AND ",
    "phone": "{c} RLIKE '[0-9]{{4}}' AND ",
    "ssn": "contains({c}, '-') AND ",
    "credit_card": "{c} RLIKE '[0-9]{{4}}' AND ",
    "ip_address": "contains({c}, '.') AND {c} RLIKE r'[.][0-9]{{1,3}}[.]' AND ",
}

TYPE_OF_NAME = {name: kind for kind, names in NAMES.items() for name in names}


def name_type(column_name: str) -> str | None:
    """Type of personal data a column name announces."""
    return TYPE_OF_NAME.get(column_name.lower().replace(" ", "_").replace("-", "_"))


def type_of_name(column_name: str) -> Column:
    """Type of personal data a column name, itself a value, announces; else null."""
    entries = ", ".join(f"'{name}', '{kind}'" for name, kind in TYPE_OF_NAME.items())
    return F.expr(f"try_element_at(map({entries}), regexp_replace(lower({column_name}), '[ -]', '_'))")


def remediation_sql(pii_type: str) -> str:
    """Advice for a type, with a default for unknown types."""
    cases = " ".join(f"WHEN '{kind}' THEN {text_sql(advice)}" for kind, advice in REMEDIATION.items())
    return f"CASE {pii_type} {cases} ELSE {text_sql(DEFAULT_REMEDIATION)} END"


def remediation(pii_type: str) -> Column:
    return F.expr(remediation_sql(pii_type))


def matches_sql(c: str, pii_type: str) -> str:
    """True when the text holds a match of the type anywhere."""
    need = _NEEDS.get(pii_type, "").format(c=c)
    return f"({need}{c} RLIKE {pattern_sql(TESTS[pii_type])})"


def type_of_value_sql(c: str) -> str:
    """First type, in pattern order, found anywhere in the text, else null.

    Phone precedes card and has no digit boundary, so an unbroken 16-digit
    number counts as a phone number.
    """
    def case(names: list[str]) -> str:
        return " ".join(f"WHEN {matches_sql(c, n)} THEN '{n}'" for n in names)

    def in_digits(names: list[str]) -> str:
        return " ".join(f"WHEN {c} RLIKE {pattern_sql(PATTERNS[n])} THEN '{n}'" for n in names)

    # no pattern matches fewer than six characters; phone, ssn and card need
    # four digits in a row, so one test spares all three
    return (
        f"CASE WHEN octet_length({c}) < 6 THEN null {case(['email'])}"
        f" WHEN {c} RLIKE '[0-9]{{4}}' THEN CASE {in_digits(['phone', 'ssn', 'credit_card'])}"
        f" {case(['ip_address'])} END"
        f" {case(['ip_address'])} END"
    )


def matches(c: str, pii_type: str) -> Column:
    return F.expr(matches_sql(c, pii_type))


def type_of_value(c: str) -> Column:
    return F.expr(type_of_value_sql(c))


def mask(c: Column, pii_type: Column | str) -> Column:
    """Value with its middle starred out.

    An email with exactly one '@' keeps two leading characters and its domain;
    other values keep two at each end.  Four characters or fewer show nothing.
    """
    kind = F.lit(pii_type) if isinstance(pii_type, str) else pii_type
    s = c.cast("string")
    parts = F.split(s, "@", -1)
    ends = F.concat(
        F.substring(s, 1, 2),
        F.repeat(F.lit("*"), F.greatest(F.length(s) - 4, F.lit(0))),
        F.right(s, F.lit(2)),
    )
    return (
        F.when(s.isNull() | (s == ""), s)
        .when(
            (kind == "email") & (F.size(parts) == 2),
            F.concat(F.substring(F.get(parts, F.lit(0)), 1, 2), F.lit("***@"), F.get(parts, F.lit(1))),
        )
        .when(F.length(s) > 4, ends)
        .otherwise(F.lit("***"))
    )


def mask_last_four(c: Column) -> Column:
    """Every digit starred except the last four; separators stay."""
    return F.regexp_replace(c.cast("string"), r"\d(?=(?:\D*\d){4})", "*")


def hash_value(c: Column, salt: str = "") -> Column:
    """One-way 16-digit pseudonym; give a salt to make guessing harder."""
    text = c.cast("string")
    return short_hash(F.concat(F.lit(salt), text) if salt else text)


def anonymize_ip(c: Column) -> Column:
    """Last octet of every address in the text set to zero."""
    return F.regexp_replace(c, r"\b((?:\d{1,3}\.){3})\d{1,3}\b", "$10")


def birth_year(c: Column) -> Column:
    """Year of a date or of ISO date text."""
    return F.year(c.try_cast("timestamp_ntz"))


def redaction_pattern(pii_type: str) -> str:
    """What redaction replaces; the rest of a digit run goes with a phone number."""
    return SPANS[pii_type] + (r"[0-9]*" if pii_type == "phone" else "")


def redact(df: DataFrame, columns: list[str], types: dict[str, list[str]] | None = None) -> DataFrame:
    """Table whose text columns have every match replaced; ``types`` limits what is replaced in a column."""
    steps = df
    for name in REDACTED:  # one step a projection: expressions stay small
        new = {}
        for c in columns:
            if types is None or name in types.get(c, REDACTED):
                need = _NEEDS[name].format(c=quoted(c)).removesuffix(" AND ")
                pattern = pattern_sql(redaction_pattern(name))
                new[c] = F.expr(f"CASE WHEN {need} THEN regexp_replace({quoted(c)}, {pattern}, '[{name}]') ELSE {quoted(c)} END")
        steps = steps.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in steps.columns]) if new else steps
    return steps


def remedied(c: Column, pii_type: str, salt: str = "") -> Column:
    """Column after the advice for its type has been followed."""
    if pii_type in ("phone", "credit_card"):
        # masked digits match no pattern; an address among them would stay
        return F.regexp_replace(mask_last_four(c), SPANS["email"], "[email]")
    if pii_type == "ip_address":
        return anonymize_ip(c.cast("string"))
    if pii_type == "date_of_birth":
        return birth_year(c)
    if pii_type in ("address", "financial"):
        return mask(c, pii_type)
    return hash_value(c, salt)
