"""Tables in buckets: what an upsert writes, what readers see, and differences of versions."""

import os

import pytest

from tablecare.sources import bucketed
from tablecare.sources.bucketed import BucketedTable, ConflictError

SCHEMA = "k bigint, v string"


@pytest.fixture
def store(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_other_buckets_keep_their_files(spark, store):
    assert len(store.upsert(frame(spark, [(i, f"a{i}") for i in range(200)]))) == 8
    before = store.manifest()["folders"]
    touched = store.upsert(frame(spark, [(3, "new"), (1000, "more")]))
    after = store.manifest()["folders"]
    assert 1 <= len(touched) <= 2 and {int(b) for b in before if before[b] != after[b]} == set(touched)
    want = {i: f"a{i}" for i in range(200)} | {3: "new", 1000: "more"}
    assert dict(rows(store.read())) == want and store.read().count() == 201


def test_twice_is_once_and_null_keys_meet(spark, store):
    batch = frame(spark, [(None, "x"), (1, "y")])
    store.upsert(batch)
    store.upsert(batch)
    store.upsert(frame(spark, [(None, "z")]))
    assert rows(store.read()) == sorted([(1, "y"), (None, "z")], key=str)
    assert store.upsert(frame(spark, [])) == [] and store.version() == 3


def test_last_of_a_repeated_key(spark, store):
    store.upsert(frame(spark, [(1, "a"), (1, "c"), (1, "b")]), order_by=["v"])
    assert rows(store.read()) == [(1, "c")]


def test_a_crash_before_the_commit_changes_nothing(spark, store, monkeypatch):
    store.upsert(frame(spark, [(i, "old") for i in range(50)]))
    monkeypatch.setattr(BucketedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError, match="gone"):
        store.upsert(frame(spark, [(i, "new") for i in range(50)]))
    monkeypatch.undo()
    assert {v for _, v in rows(store.read())} == {"old"} and store.version() == 1
    store.upsert(frame(spark, [(i, "new") for i in range(50)]))
    assert {v for _, v in rows(store.read())} == {"new"} and store.read().count() == 50


def test_a_crash_while_the_manifest_is_written_changes_nothing(spark, store, tmp_path):
    store.upsert(frame(spark, [(1, "old")]))
    with open(tmp_path / "t" / "manifests" / ".half", "w") as f:
        f.write('{"schema"')
    assert rows(store.read()) == [(1, "old")] and store.version() == 1


def test_readers_keep_their_version(spark, store):
    store.upsert(frame(spark, [(1, "old"), (2, "old")]))
    reader = store.read()
    store.upsert(frame(spark, [(1, "new"), (2, "new")]))
    assert rows(reader) == [(1, "old"), (2, "old")] and rows(store.read()) == [(1, "new"), (2, "new")]
    assert rows(store.read(1)) == [(1, "old"), (2, "old")]


def test_the_second_of_two_writers_fails(spark, store, monkeypatch):
    store.upsert(frame(spark, [(1, "a")]))
    monkeypatch.setattr(BucketedTable, "version", lambda self: 1)
    store.upsert(frame(spark, [(1, "b")]))
    with pytest.raises(ConflictError):
        store.upsert(frame(spark, [(1, "c")]))
    monkeypatch.undo()
    assert rows(store.read()) == [(1, "b")] and store.version() == 2


def test_changes_between_versions(spark, store):
    store.upsert(frame(spark, [(i, f"a{i}") for i in range(300)]))
    store.upsert(frame(spark, [(i, f"a{i}") for i in range(0, 300, 3)]))  # written anew, nothing changed
    assert store.differing(1, 2) == [] and store.changes(1, 2).isEmpty()
    store.upsert(frame(spark, [(5, "x"), (900, "y"), (None, "z")]))
    store.delete(frame(spark, [(7,), (8,), (12345,)], "k bigint"))
    assert rows(store.changes(2, 4)) == sorted([(5, "changed"), (900, "added"), (None, "added"), (7, "removed"), (8, "removed")], key=str)
    assert len(store.differing(2, 4)) <= 5 and rows(store.changes(4, 2))[0][1] in ("added", "changed", "removed")
    assert {c for _, c in rows(store.changes(0, 1))} == {"added"}


def test_equal_buckets_are_not_read(spark, store, tmp_path):
    store.upsert(frame(spark, [(i, f"a{i}") for i in range(100)]))
    touched = store.upsert(frame(spark, [(4, "x")]))
    for bucket, folder in store.manifest()["folders"].items():
        if int(bucket) not in touched:
            for name in os.listdir(tmp_path / "t" / folder):
                file = tmp_path / "t" / folder / name
                file.write_bytes(b"\0" * file.stat().st_size)
    assert rows(store.changes(1, 2)) == [(4, "changed")]
    assert rows(store.changes(2, 2)) == []


def test_all_rows_of_a_bucket_deleted(spark, store):
    store.upsert(frame(spark, [(1, "a")]))
    store.delete(frame(spark, [(1,)], "k bigint"))
    assert store.read().isEmpty() and store.read().columns == ["k", "v"]
    store.upsert(frame(spark, [(1, "b")]))
    assert rows(store.read()) == [(1, "b")]
    assert bucketed._BUCKET not in store.read().columns
