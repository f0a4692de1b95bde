import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecare.functions import pii
from tablecare.operators import personal


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize("value, kind, masked", [
    ("john.doe@example.com", "email", "jo***@example.com"),
    ("a@b@c.de", "email", "a@****de"),
    ("555-123-4567", "phone", "55********67"),
    ("123-45-6789", "ssn", "12*******89"),
    ("1234", "phone", "***"),
    ("123", "credit_card", "***"),
    ("abcd", "other", "***"),
    ("abcde", "other", "ab*de"),
    ("", "email", ""),
    (None, "phone", None),
])
def test_mask(spark, value, kind, masked):
    assert one(spark, value, pii.mask(F.col("v"), kind)) == masked


def test_hash(spark):
    assert one(spark, "john.doe@example.com", pii.hash_value(F.col("v"))) == "836f82db99121b34"
    salted = one(spark, "x", pii.hash_value(F.col("v"), salt="s"))
    assert salted == hashlib.sha256(b"sx").hexdigest()[:16]


@pytest.mark.parametrize("text, kind", [
    ("write to jo@site.org now", "email"),
    ("+1-555-123-4567", "phone"),
    ("(555) 123 4567", "phone"),
    ("123-45-6789", "ssn"),
    ("4111 1111 1111 1111", "credit_card"),
    # no digit boundary in the phone pattern
    ("4111111111111111", "phone"),
    ("host 10.0.0.1 up", "ip_address"),
    ("1.1.1.1", "ip_address"),
    ("nothing here 12", None),
    ("", None),
    (None, None),
])
def test_type_of_value(spark, text, kind):
    assert one(spark, text, pii.type_of_value("v")) == kind


TEXT = st.text(alphabet="0123456789-. ()+@abcXY", min_size=0, max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=100, max_size=200))
def test_cheap_conditions_never_hide_a_match(spark, texts):
    """The conditions tested before a pattern leave its result as it is."""
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = pii.redact(df.select("v", pii.type_of_value("v").alias("kind"), F.col("v").alias("redacted")), ["redacted"]).collect()
    for row in rows:
        want = next((n for n, p in pii.PATTERNS.items() if re.search(p, row["v"], re.ASCII)), None)
        assert row["kind"] == want
        redacted = row["v"]
        for name in pii.REDACTED:
            redacted = re.sub(pii.PATTERNS[name] + ("[0-9]*" if name == "phone" else ""), f"[{name}]", redacted, flags=re.ASCII)
        assert row["redacted"] == redacted


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc@0.-", min_size=5, max_size=30), min_size=50, max_size=100))
def test_mask_shows_at_most_its_ends(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", pii.mask(F.col("v"), "phone").alias("m")).collect():
        assert row["m"] == row["v"][:2] + "*" * (len(row["v"]) - 4) + row["v"][-2:]


def test_names(spark):
    names = ["E-Mail", "first name", "DOB", "salary", "passport", "amount", "emails"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kinds = [r[0] for r in df.select(pii.type_of_name("n")).collect()]
    assert kinds == ["email", "personal_name", "date_of_birth", "financial", "potential_pii", None, None]
    assert [pii.name_type(n) for n in names] == kinds


def test_detection_prefers_the_name(spark):
    df = spark.createDataFrame([("10.0.0.1", "x 555-123-4567", 5551234567)], "email string, contact string, number bigint")
    rows = {r["column"]: r for r in personal.detect_pii(df).collect()}
    assert (rows["email"]["type"], rows["email"]["detection_method"]) == ("email", "column_name_match")
    assert (rows["contact"]["type"], rows["contact"]["detection_method"]) == ("phone", "value_pattern_match")
    assert "number" not in rows
    every = {r["column"]: r["type"] for r in personal.detect_pii(df, scan_all_types=True).collect()}
    assert every["number"] == "phone"


def test_full_scan_takes_the_most_frequent_type_and_sample_the_first(spark):
    rows = [(0, "10.0.0.1"), (1, "a@b.co"), (2, "c@d.co"), (3, "plain")]
    df = spark.createDataFrame(rows, "k int, v string")
    full = {r["column"]: r["type"] for r in personal.detect_pii(df).collect()}
    sample = {r["column"]: r["type"] for r in personal.detect_pii(df, mode="sample", order_by=["k"]).collect()}
    assert full == {"v": "email"} and sample == {"v": "ip_address"}


def test_match_far_into_a_long_text_is_found(spark):
    df = spark.createDataFrame([("word " * 20_000 + "a.b@c.org",)], "v string")
    assert [r["type"] for r in personal.detect_pii(df).collect()] == ["email"]


def test_remediation_text(spark):
    df = spark.createDataFrame([("email",), ("shoe_size",)], "t string")
    texts = [r[0] for r in df.select(pii.remediation("t")).collect()]
    assert texts == [pii.REMEDIATION["email"], pii.DEFAULT_REMEDIATION]


@pytest.mark.parametrize("kind, value, treated", [
    ("phone", "+1-555-123-4567", "+*-***-***-4567"),
    ("credit_card", "4111 1111 1111 1234", "**** **** **** 1234"),
    ("ip_address", "10.1.2.3 and 10.1.2.34", "10.1.2.0 and 10.1.2.0"),
    ("date_of_birth", "1980-05-06", 1980),
    ("address", "12 Main Street", "12**********et"),
])
def test_remedies(spark, kind, value, treated):
    df = spark.createDataFrame([(value,)], "v string")
    assert personal.remedy_columns(df, {"v": kind}).first()[0] == treated


def test_matches_as_rows(spark):
    df = spark.createDataFrame([(1, "a@b.co, c@d.co 10.0.0.1"), (2, "none")], "k int, v string")
    rows = {tuple(r) for r in personal.pii_matches(df, "k", "v").collect()}
    assert rows == {(1, "email", "a@b.co"), (1, "email", "c@d.co"), (1, "ip_address", "10.0.0.1")}


def test_no_value_stalls_a_search(spark):
    """Long digit runs, and a long run of letters with a detached '@', take a moment only."""
    values = ["7" * 100_000, "a" * 200_000 + " @", "x" * 100_000 + "@", "1." * 50_000, "pay 4111111111111111 now", "4111 1111 1111 1111 2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = pii.redact(df.select("v", pii.type_of_value("v").alias("k"), F.col("v").alias("r")), ["r"]).collect()
    assert [r["k"] for r in rows] == ["phone", None, None, "ip_address", "phone", "credit_card"]
    assert rows[0]["r"] == "[phone]" and rows[4]["r"] == "pay [credit_card] now" and rows[5]["r"] == "[credit_card] 2"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab_.@-c0 ", min_size=0, max_size=30), min_size=100, max_size=200))
def test_email_spans_equal_the_plain_pattern(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, v string")
    found = {}
    for r in personal.pii_matches(df, "k", "v").where("kind = 'email'").collect():
        found.setdefault(r["id"], []).append(r["value"])
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == sorted(re.findall(pii.PATTERNS["email"], t))
