"""Streams over several runs: late rows, repeats and what is opened for them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecare.streaming import jobs


@pytest.fixture
def arriving(spark, tmp_path):
    source = str(tmp_path / "in")

    def put(rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        return jobs.file_stream(spark, source, df.schema, files_per_batch=1)

    return put


SCHEMA = "ts timestamp, kind string, note string"


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def windows(spark, target):
    rows = jobs.latest_windows(spark, target, [], ["note"]).collect()
    return {str(r["window_start"]): (r["events_total"], r["errors_total"], r["note_null_percent"]) for r in rows}


def test_late_rows_count_and_are_noted(spark, arriving, tmp_path):
    target, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    run = lambda stream: jobs.windowed_errors(stream, "ts", "1 hour", "10 minutes", [], F.col("kind") == "error", target, offsets, ["note"])
    run(arriving([(at(1, 10, 5), "error", "x"), (at(1, 10, 6), "fine", None), (at(2, 0), "fine", "y")], SCHEMA))
    run(arriving([(at(1, 10, 30), "error", None), (at(1, 11, 30), "error", "z"), (at(2, 0, 1), "fine", "w"), (None, "error", None)], SCHEMA))
    want = {"2024-01-01 10:00:00": (3, 2, 66.67), "2024-01-01 11:00:00": (1, 1, 0.0), "2024-01-02 00:00:00": (2, 0, 0.0), "None": (1, 1, 100.0)}
    assert windows(spark, target) == want
    late = {(r["batch_id"], str(r["window_start"]), r["late_total"]) for r in jobs.late_rows(spark, target).collect()}
    assert late == {(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 11:00:00", 1)}


def test_compaction_changes_nothing(spark, arriving, tmp_path):
    target, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    total = 0
    for i in range(5):
        stream = arriving([(at(1, h, i), "error" if h % 2 else "fine", None if h % 3 else "n") for h in range(6)], SCHEMA)
        jobs.windowed_errors(stream, "ts", "1 hour", "10 minutes", [], F.col("kind") == "error", target, offsets, ["note"])
        total += 6
        before = windows(spark, target)
        if i % 2:
            jobs.compact_windows(spark, target)
            jobs.compact_windows(spark, target)
        assert windows(spark, target) == before
    assert sum(n for n, _, _ in before.values()) == total
    assert before["2024-01-01 01:00:00"] == (5, 5, 100.0) and before["2024-01-01 03:00:00"] == (5, 5, 0.0)


def index(spark, tmp_path, fields):
    return jobs.KeyIndex(spark, str(tmp_path / "index"), spark.createDataFrame([], fields).schema.fields)


def test_only_files_that_may_hold_a_key_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.KeyIndex, "KEYS", 100)
    own = index(spark, tmp_path, "id bigint")
    for b in range(4):  # batches of 1600 keys in sixteen slices each; odd numbers are in none
        own.add(spark.range(b * 3200, (b + 1) * 3200, 2), b)
    opened = lambda df: own.opened(df, 99).collect()
    assert opened(spark.range(50_000, 60_000)) == []
    assert {(r["batch_id"]) for r in opened(spark.range(3200, 3210, 2))} == {1}
    assert len(opened(spark.range(6400, 6402, 2))) == 1
    # keys that no batch has pass few filters: sixteen slices a batch hold the range
    assert len(opened(spark.range(1, 3200, 320))) <= 4
    assert own.opened(spark.range(3200, 3210), 1).collect() == []  # a replayed batch isn't compared with itself


def test_without_keeps_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.KeyIndex, "KEYS", 10)
    own = index(spark, tmp_path, "a string, b int")
    rows = [("x", 1), ("x", None), (None, 1), (None, None), *[(f"k{i}", i) for i in range(300)]]
    own.add(spark.createDataFrame(rows, "a string, b int"), 0)
    more = [("x", 2), ("y", None), ("k301", 301)]
    left = own.without(spark.createDataFrame([*rows, *more], "a string, b int"), 1).collect()
    assert sorted(map(tuple, left), key=str) == sorted(more, key=str)
    assert own.without(spark.createDataFrame(rows, "a string, b int"), 0).count() == len(rows)


def test_dedup_over_many_batches(spark, arriving, tmp_path):
    target, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    for b in range(4):
        rows = [(i, f"t{i}", at(1, i % 24)) for i in range(b * 50, b * 50 + 100)] + [(None, "null", at(1, 0))]
        jobs.drop_repeats(arriving(rows, "id int, v string, ts timestamp"), ["id"], target, offsets)
    found = spark.read.parquet(target)
    assert found.columns == ["id", "v", "ts", "batch_id"]
    assert sorted((r["id"] is None, r["id"], r["v"]) for r in found.collect())[:-1] == [(False, i, f"t{i}") for i in range(250)]
    assert found.where("id IS NULL").count() == 1
