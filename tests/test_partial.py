"""Profiles from states of parts."""

import datetime as dt
import os
import random

import pytest

from tablecare.operators import partial
from tablecare.operators.profile import profile_columns

SCHEMA = "day date, id long, v double, whole int, name string, mail string, seen string, tags array<int>, at timestamp_ntz"
EXACT = [
    "position", "column", "dtype", "semantic_type", "row_count", "null_count", "null_percent", "min", "max", "mean", "std",
    "text_values", "numeric_values", "pii_type", "pii_method", "latest",
]


def rows(day, n, seed):
    r = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    return [
        (dt.date(2024, 1, day) if day else None, i, r.choice(odd) if r.random() < 0.1 else r.gauss(1e6, 3), r.choice([None, 1, 2, -7]),
         r.choice(["12", "x", "3.5", None]), f"a{i}@example.com" if i % 3 else "none", f"2024-0{1 + i % 9}-11", [i], dt.datetime(2024, 1, 1, i % 24))
        for i in range(n)
    ]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "table")

    def put(*parts, mode="append"):
        data = [row for p in parts for row in rows(*p)]
        spark.createDataFrame(data, SCHEMA).repartition(3).write.mode(mode).partitionBy("day").parquet(path)
        return path

    return put


def plain(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_merge_is_the_whole_profile(spark, folder, tmp_path):
    path = folder((1, 50, 1), (2, 1, 2), (3, 200, 3), (None, 20, 4))
    store = partial.PartProfiles(spark, str(tmp_path / "meta"))
    assert store.add(path, "day") == ["", "2024-01-01", "2024-01-02", "2024-01-03"]
    want = profile_columns(spark.read.parquet(path).drop("day"))
    got = store.profile()
    assert got.columns == want.columns
    assert plain(got, EXACT) == plain(want, EXACT)
    # few distinct values are counted exactly
    assert plain(got, ["column", "unique_count", "duplicate_rows"]) == plain(want, ["column", "unique_count", "duplicate_rows"])


def test_only_new_parts_are_read(spark, folder, tmp_path):
    path = folder((1, 30, 1), (2, 40, 2))
    store = partial.PartProfiles(spark, str(tmp_path / "meta"))
    assert len(store.add(path, "day")) == 2
    before = {c: r for c, *r in plain(store.profile(), ["column", "row_count", "mean"])}
    for day in (1, 2):  # nothing in these files can be read any more, but their listing is the same
        part = f"{path}/day=2024-01-0{day}"
        for name in os.listdir(part):
            file = f"{part}/{name}"
            held = os.stat(file)
            with open(file, "r+b") as f:
                f.write(b"\0" * held.st_size)
            os.utime(file, ns=(held.st_atime_ns, held.st_mtime_ns))
    assert store.add(path, "day") == []
    more = spark.createDataFrame(rows(3, 25, 3), SCHEMA)
    more.write.mode("append").partitionBy("day").parquet(path)
    assert store.add(path, "day") == ["2024-01-03"]
    after = {c: r for c, *r in plain(store.profile(), ["column", "row_count", "mean"])}
    assert all(after[c][0] == before[c][0] + 25 for c in before)
    assert plain(store.parts(), ["part", "row_count"]) == [("2024-01-01", 30), ("2024-01-02", 40), ("2024-01-03", 25)]


def test_changed_and_removed_parts(spark, folder, tmp_path):
    path = folder((1, 30, 1), (2, 40, 2), (3, 10, 3))
    store = partial.PartProfiles(spark, str(tmp_path / "meta"))
    store.add(path, "day")
    folder((2, 5, 9))  # more rows of a known part
    for name in os.listdir(f"{path}/day=2024-01-03"):
        os.remove(f"{path}/day=2024-01-03/{name}")
    assert store.add(path, "day") == ["2024-01-02"]
    assert plain(store.parts(), ["part", "row_count"]) == [("2024-01-01", 30), ("2024-01-02", 45)]
    assert store.add(path, "day") == []
    want = profile_columns(spark.read.parquet(path).drop("day"))
    assert plain(store.profile(), EXACT) == plain(want, EXACT)


def test_columns_must_stay(spark, tmp_path):
    path, store = str(tmp_path / "t"), partial.PartProfiles(spark, str(tmp_path / "meta"))
    spark.createDataFrame([(1, "a")], "p int, v string").write.partitionBy("p").parquet(path)
    store.add(path, "p")
    spark.createDataFrame([(2, 5)], "p int, v int").write.mode("overwrite").partitionBy("p").parquet(path)
    with pytest.raises(ValueError, match="columns differ"):
        store.add(path, "p")


def test_error_of_the_sketch(spark):
    df = spark.range(0, 300_000, 1, 4).selectExpr("id % 5 AS part", "id % 120000 AS a", "id AS b", "CAST(id % 7 AS string) AS c")
    found = {r["column"]: r for r in partial.merged(partial.part_states(df, "part")).collect()}
    for column, exact in (("a", 120_000), ("b", 300_000)):
        assert abs(found[column]["unique_count"] / exact - 1) < 4 * partial.SKETCH_ERROR
    assert found["c"]["unique_count"] == 7
    assert found["a"]["duplicate_rows"] < 4 * partial.SKETCH_ERROR * 300_000
