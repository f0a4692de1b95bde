import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablecare.functions.hashing import row_fingerprint, table_fingerprint
from tablecare.functions.json_text import salvage_fields
from tablecare.operators import runmeta
from tablecare.operators.profile import profile_columns
from tablecare.operators.rules import check, report
from tablecare.plans.heal import heal, plan
from tablecare.plans.run import run
from tablecare.sources import tables
from tablecare.sources.session import cut_lineage
from tablecare.sources.store import RunStore
from tablecare.streaming import jobs

UTC = dt.timezone.utc


# repair

@pytest.fixture()
def messy(spark):
    rows = []
    for i in range(200):
        rows.append((
            i, None if i % 10 < 6 else i, None if i % 10 < 3 else "ab"[i % 2], None if i % 40 == 0 else i,
            -5.0 if i % 50 == 7 else float(i % 20), "n/a" if i % 5 == 0 else str(i), "X",
            f"user{i}@example.com", None if i == 9 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i),
        ))
    rows += rows[:40]
    return spark.createDataFrame(
        rows, "id int, sparse int, status string, number int, amount double, code string, fixed string,"
              " email string, seen timestamp",
    )


def test_heal(messy):
    result = heal(messy)
    scores = result.scores().first()
    assert scores["score_before"] == 44 and scores["score_after"] == 100
    fixes = {(r["iteration"], r["column"]): r["fix"] for r in result.history.collect()}
    assert fixes == {
        (1, "sparse"): "drop_column", (1, "fixed"): "drop_column", (1, "_all_"): "dedup_exact",
        (1, "email"): "remedy", (1, "code"): "safe_cast", (1, "amount"): "clip_negative",
        (1, "status"): "fill_mode", (1, "number"): "fill_median", (1, "seen"): "flag_nulls", (2, "code"): "fill_mean",
    }
    healed = result.df
    assert "sparse" not in healed.columns and "seen_was_null" in healed.columns
    assert healed.count() == 200
    assert healed.filter("email LIKE '%@%' OR amount < 0 OR code IS NULL OR number IS NULL").isEmpty()
    assert dict(healed.dtypes)["number"] == "int"


def test_heal_log_and_undo(messy):
    result = heal(messy, log_keys=["id"])
    found = {(r["iteration"], r["column"], r["fix"]): (r["n"], r["copies"]) for r in result.changes().groupBy("iteration", "column", "fix").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()}
    unique = messy.distinct()
    assert found[1, "_all_", "dedup_exact"] == (40, 40)
    assert found[1, "amount", "clip_negative"][0] == unique.where("amount < 0").count()
    assert found[1, "status", "fill_mode"][0] == unique.where("status IS NULL").count()
    assert found[2, "code", "fill_mean"][0] == unique.where("code = 'n/a'").count()
    assert found[1, "email", "remedy"][0] == unique.where("email IS NOT NULL").count()
    back = result.undo()
    assert back.dtypes == messy.dtypes and back.exceptAll(messy).isEmpty() and messy.exceptAll(back).isEmpty()


def test_heal_log_edges(spark):
    df = spark.createDataFrame([(None, "a", -1.0), (1, "a", 2.0), (1, "a", 2.0), (2, None, None)] + [(i, "b", 3.0) for i in range(3, 30)], "id int, key string, amount double")
    result = heal(df, log_keys=["id"])  # a null key, a repeat that is too rare to go, a column named as the log's
    back = result.undo()
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert {(r["key"]["id"], r["column"]) for r in result.changes().collect()} >= {(None, "amount"), (2, "key")}
    with pytest.raises(ValueError, match="share a key"):
        heal(df.unionAll(spark.createDataFrame([(1, "z", 2.0)], df.schema)), log_keys=["id"])
    clean_ = heal(spark.range(50).selectExpr("id", "id % 3 AS part"), log_keys=["id"])
    assert clean_.changes().isEmpty() and clean_.undo().count() == 50
    with pytest.raises(ValueError, match="log_keys"):
        heal(df).undo()


def test_run_tries_the_transform_first(spark, tmp_path):
    from tablecare.plans.run import SimulationError

    df = spark.range(60).selectExpr("id", "id % 7 AS part", "id * 1.5D AS amount")
    store = RunStore(spark, str(tmp_path / "meta"))
    result = run(df, str(tmp_path / "out"), store, transform=lambda d: d.where("part < 3").withColumn("twice", F.col("amount") * 2))
    assert (result.simulated.input_rows, result.simulated.output_rows) == (60, df.where("part < 3").count())
    out = spark.read.parquet(str(tmp_path / "out"))
    assert "twice" in out.columns and out.count() == result.simulated.output_rows
    stages = [(r["stage"], r["status"]) for r in store.table("stages").collect()]
    assert ("simulate", "completed") in stages
    nodes = [(r["name"], r["input_rows"], r["output_rows"]) for r in store.table("lineage").where("type = 'transformation'").orderBy("seq").collect()]
    assert nodes == [("heal", 60, 60), ("transform", 60, out.count())]
    for n, wrong in enumerate([lambda d: d.select("absent"), lambda d: d.where("id < 0"), lambda d: d.selectExpr("raise_error('no') AS x")]):
        with pytest.raises(SimulationError):
            run(df.withColumn("n", F.lit(n)), str(tmp_path / f"out{n}"), store, transform=wrong)
        assert not (tmp_path / f"out{n}").exists()
    assert store.table("stages").where("stage = 'simulate' AND status = 'failed'").count() == 3


def test_landing_takes_each_file_once(spark, tmp_path, monkeypatch):
    from tablecare.sources.landing import Landing

    source = tmp_path / "in"
    source.mkdir()
    (source / "a 1.csv").write_text("id,name\n1,x\n2,n/a\n")
    (source / "b[2].csv").write_text("id,name\n3,y\n")
    landing = Landing(spark, str(tmp_path / "landed"))
    assert landing.rows() is None and landing.pending(str(tmp_path / "absent")).isEmpty()
    assert landing.land(str(source), "r1").count() == 2
    assert landing.land(str(source), "r2").isEmpty()
    got = lambda: sorted((r["id"], r["name"], r["run_id"]) for r in landing.rows().collect())
    assert got() == [("1", "x", "r1"), ("2", None, "r1"), ("3", "y", "r1")]
    # a changed file counts as it is now, a new one may have other columns
    (source / "b[2].csv").write_text("id,name\n30,z\n31,z\n")
    assert [r["run_id"] for r in landing.land(str(source), "r3").collect()] == ["r3"]
    (source / "c.csv").write_text("id,more\n5,m\n")
    landing.land(str(source), "r4")
    assert got() == [("1", "x", "r1"), ("2", None, "r1"), ("30", "z", "r3"), ("31", "z", "r3"), ("5", None, "r4")]
    assert {r["file_name"] for r in landing.rows().collect()} == {"a 1.csv", "b[2].csv", "c.csv"}
    # a run that breaks off before the ledger's entry leaves no rows, and its files are landed again
    (source / "d.csv").write_text("id,name\n9,q\n")
    whole = landing._ledger
    landing._ledger = "nowhere://x"
    monkeypatch.setattr(landing, "ledger", lambda: spark.read.parquet(whole))
    with pytest.raises(Exception):
        landing.land(str(source), "r5")
    monkeypatch.undo()
    landing._ledger = whole
    assert len(got()) == 5
    assert landing.land(str(source), "r6").count() == 1 and ("9", "q", "r6") in got()


def test_heal_of_a_clean_table_changes_nothing(spark):
    df = spark.range(50).selectExpr("id", "id % 3 AS part")
    result = heal(df)
    assert result.passes == 0 and result.history.isEmpty()
    assert sorted(result.df.collect()) == sorted(df.collect())


def test_heal_never_lowers_the_score(spark):
    for seed in range(3):
        df = spark.range(60).selectExpr(
            "id", f"CASE WHEN rand({seed}) < 0.3 THEN NULL ELSE id * 1.0 - 5 END AS amount",
            f"CASE WHEN rand({seed + 9}) < 0.4 THEN NULL ELSE CAST(id % 4 AS string) END AS code",
        )
        df = cut_lineage(df)
        scores = heal(df).scores().first()
        assert 0 <= scores["score_before"] <= scores["score_after"] <= 100


def test_plan_keeps_one_column(spark):
    df = spark.createDataFrame([("x",), ("x",)], "only string")
    profile = profile_columns(df)
    fixes = plan(check(profile).collect(), profile.collect(), set())
    assert [f.action for f in fixes] == ["dedup_exact"]


def test_run_records_and_skips(spark, tmp_path, messy):
    store = RunStore(spark, str(tmp_path / "meta"))
    target = str(tmp_path / "out")
    first = run(messy, target, store, as_of="2024-06-01", name="messy")
    assert not first.skipped and spark.read.parquet(target).count() == 200
    assert first.report.first()["quality_score"] == 44
    done = {r["stage"]: r["status"] for r in store.latest_stages().collect()}
    assert done == dict.fromkeys(["profile", "check", "heal", "write"], "completed")
    assert all(r["started_at"] for r in store.latest_stages().collect())
    names = {r["name"] for r in runmeta.session_metrics(store.table("points"), first.run_id).collect()}
    assert {"quality_score", "input_rows", "profile_duration_ms"} <= names
    assert runmeta.lineage_row_delta(store.table("lineage")).first()["row_delta"] == -40
    # the same rows in another order are the same input
    second = run(messy.orderBy(F.desc("id")), target, store, name="messy")
    assert second.skipped
    assert not run(messy.limit(100), str(tmp_path / "other"), store).skipped


def test_run_records_failures(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "meta"))
    bad = spark.createDataFrame([("x",)], "v string").selectExpr("CAST(v AS int) AS n")
    with pytest.raises(Exception):
        run(bad, str(tmp_path / "out"), store, input_hash="v1")
    row = store.latest_stages().first()
    assert (row["stage"], row["status"]) == ("profile", "failed") and "CAST_INVALID_INPUT" in row["error"]
    assert not store.completed_input("write", "v1")


def test_drift_between_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "meta"))
    first = run(spark.range(5).selectExpr("id", "id AS a"), str(tmp_path / "1"), store)
    second = run(spark.range(5).selectExpr("id", "CAST(id AS string) AS b"), str(tmp_path / "2"), store,
                 previous=first.profile)
    rules = {(r["rule"], r["column"]) for r in second.findings.filter("category = 'schema_drift'").collect()}
    assert rules == {("new_column", "b"), ("removed_column", "a")}


# metadata

def test_metric_keys(spark):
    df = spark.sql("SELECT 'm' AS n, map('z', '1', 'a', '2') AS l UNION ALL SELECT 'm', map() UNION ALL SELECT 'm', null")
    keys = [r[0] for r in df.select(runmeta.metric_key(F.col("n"), F.col("l"))).collect()]
    assert keys == ["m:a=2,z=1", "m", "m"]


def test_metrics_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.table("points").isEmpty()
    summary = runmeta.metrics_summary(store.table("points"), store.table("events")).first()
    assert tuple(summary) == (0, 0, [], [])
    store.record("test_metric", 42.0, {"session_id": "s1"})
    store.record("test_metric", 43.0, {"session_id": "s1", "part": "x"})
    store.record("test_metric", 1.0, {"session_id": "s2"})
    store.record_event("created", "s3", {"file": "f.csv"})
    # both label sets of the session stay
    assert sorted(r["value"] for r in runmeta.session_metrics(store.table("points"), "s1").collect()) == [42.0, 43.0]
    summary = runmeta.metrics_summary(store.table("points"), store.table("events")).first()
    assert tuple(summary) == (3, 1, ["test_metric"], ["created"])


def test_phase_durations(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", "start", t(1)), ("a", "stop", t(3)), ("b", "stop", t(5))],
                               "session string, what string, ts timestamp")
    rows = runmeta.phase_durations(df, ["session"], F.col("what") == "start", F.col("what") == "stop").collect()
    assert {r["session"]: r["duration_ms"] for r in rows} == {"a": 2000, "b": 0}


def test_lineage(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.record_nodes("s", [{"type": "source", "name": "sales.csv"}])
    store.record_nodes("s", [
        {"type": "transformation", "name": "clean_nulls", "input_rows": 1000, "output_rows": 950},
        {"type": "sink", "name": "sales_table", "row_count": 950},
    ])
    nodes = store.table("lineage")
    edges = [(r["from_name"], r["to_name"]) for r in runmeta.lineage_edges(nodes).orderBy("from_seq").collect()]
    assert edges == [("sales.csv", "clean_nulls"), ("clean_nulls", "sales_table")]
    assert runmeta.lineage_row_delta(nodes).first()["row_delta"] == -50
    assert runmeta.lineage_mermaid(nodes, "s") == "\n".join([
        "graph LR", '    N0[("sales.csv")]', '    N1["clean_nulls\\n1000→950 rows"]', "    N0 --> N1",
        '    N2[("sales_table\\n950 rows")]', "    N1 --> N2",
    ])


def test_checkpoints(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=UTC)
    assert not store.is_completed("r", "load")
    store.mark("r", "load", "started", input_hash="h", ts=at(1))
    assert not store.is_completed("r", "load")
    store.mark("r", "load", "completed", input_hash="h", ts=at(2))
    store.mark("r", "write", "started", ts=at(3))
    store.mark("r", "write", "failed", error="boom", ts=at(4))
    assert store.is_completed("r", "load") and store.completed_input("load", "h")
    latest = {r["stage"]: r for r in store.latest_stages().collect()}
    assert latest["write"]["status"] == "failed" and latest["write"]["error"] == "boom"
    assert latest["load"]["started_at"].minute == 1
    assert tuple(store.progress().first()) == ("r", 1, 2)
    with pytest.raises(ValueError):
        store.mark("r", "load", "done")


def test_watermarks(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.get_watermark("sales") == ""
    store.set_watermark("sales", "2024-01-15T00:00:00Z", ts=dt.datetime(2024, 1, 1, tzinfo=UTC))
    store.set_watermark("sales", "2024-01-16T00:00:00Z", ts=dt.datetime(2024, 1, 2, tzinfo=UTC))
    assert store.get_watermark("sales") == "2024-01-16T00:00:00Z"
    assert store.get_watermark("other") == ""


def test_incremental_reads_share_no_row_and_miss_none(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, day(1)), (2, day(2)), (3, day(2))]
    seen = []
    for more in ([], [(4, day(2)), (10, day(9))], []):
        rows += more
        df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
        fresh, mark = store.read_since(df, "events", "ts", tie="id")
        seen.append(sorted(r["id"] for r in fresh.collect()))
        store.set_watermark("events", mark)
    # 10 is compared with 3 as a number
    assert seen == [[1, 2, 3], [4, 10], []]


def test_a_mark_holds_any_text_and_never_moves_back(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    df = spark.createDataFrame([("a|1", 1), ("a|2", None), ("a|2", 2)], "v string, k int")
    fresh, mark = store.read_since(df, "s", "v", tie="k")
    assert fresh.count() == 3 and tuple(mark) == ("a|2", "2")
    store.set_watermark("s", mark)
    assert store.read_since(df, "s", "v", tie="k")[0].isEmpty()
    store.set_watermark("n", "10")
    store.set_watermark("n", "9")
    assert store.get_watermark("n") == "10" and store.get_watermark("s") == "a|2"


def test_rows_that_arrive_during_a_read_wait(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(source)
    store = RunStore(spark, str(tmp_path / "meta"))
    fresh, mark = store.read_since(spark.read.parquet(source), "s", "v")
    assert mark.value == "2" and sorted(r["v"] for r in fresh.collect()) == [1, 2]
    assert fresh.where("v > 2").isEmpty()


def test_edges_lead_over_missing_numbers(spark):
    nodes = spark.createDataFrame([("s", 0, "a"), ("s", 2, "b"), ("s", 7, "c"), ("t", 4, "x")], "session_id string, seq int, name string")
    edges = [(r["from_seq"], r["to_seq"]) for r in runmeta.lineage_edges(nodes).orderBy("to_seq").collect()]
    assert edges == [(0, 2), (2, 7)]


def test_bad_lines_are_found(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    assert [r["line"] for r in tables.csv_rejects(spark, str(tmp_path / "t.csv")).collect()] == ["3,4,5"]
    (tmp_path / "t.json").write_text('{"a": 1}\n{oops\n{"a": 2}\n')
    assert [r["line"] for r in tables.json_rejects(spark, str(tmp_path / "t.json"), "a int").collect()] == ["{oops"]
    assert tables.read_or_empty(spark, str(tmp_path / "t.json"), "a int", "json").count() == 2


def test_unprocessed(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "h string")
    ledger = spark.createDataFrame([("a", "completed"), ("a", "completed"), ("b", "failed")], "h string, status string")
    assert sorted(r["h"] for r in runmeta.unprocessed(inputs, ledger, ["h"]).collect()) == ["b", "c"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    same = spark.createDataFrame([(2, None), (1, "a"), (2, None)], "k int, v string")
    other = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    print_of = lambda d: tuple(table_fingerprint(d).first())
    assert print_of(df) == print_of(same) != print_of(other)
    rows = [r[0] for r in df.select(row_fingerprint(["k", "v"])).collect()]
    assert rows[1] == rows[2] != rows[0] and len(rows[0]) == 16


# JSON text

BROKEN = '''```json
{
  "code": "total = \\"sum\\"\\nif total:\\n\\tshow(total)",
  "ddl": "CREATE TABLE visits (day DATE);",
  "why": "because"
'''


@pytest.mark.parametrize("raw, want", [
    (json.dumps({"a": "x\ny", "b": 5}), ("x\ny", "5")),
    ('```json\n{"a": "x", "b": "5"}\n```', ("x", "5")),
    ('Sure! {"a": "x"} Bye', ("x", None)),
    ('{"a": "x", "b": "5', ("x", "5")),
    ('{"a": "say \\"hi\\"", "b": 7, oops', ('say "hi"', "7")),
    ("nothing", (None, None)),
    (None, (None, None)),
])
def test_salvage(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    row = salvage_fields(df, "raw", ["a", "b"]).first()
    assert (row["a"], row["b"]) == want


def test_salvage_of_an_unclosed_fenced_object(spark):
    keys = ["code", "ddl", "why"]
    row = salvage_fields(spark.createDataFrame([(BROKEN,)], "raw string"), "raw", keys).first()
    assert row["code"] == 'total = "sum"\nif total:\n\tshow(total)'
    assert row["ddl"] == "CREATE TABLE visits (day DATE);" and row["why"] == "because"


# sources and sinks

def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'i,f,b,d,s,e,q\n1,1.5,True,2024-01-01,x,,"a ""b"", c"\nNA,nan,false,,n/a,NULL,d\n-3,2,TRUE,2024-02-01,10,,e\n'
    )
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "d": "date", "s": "string",
                               "e": "double", "q": "string"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, -3] and [r["f"] for r in rows] == [1.5, None, 2.0]
    assert [r["s"] for r in rows] == ["x", None, "10"] and rows[0]["q"] == 'a "b", c'
    assert dict(tables.read_csv(spark, str(path), dates=False).dtypes)["d"] == "string"


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"one\ntwo",1\nthree,2\n')
    df = tables.read_csv(spark, str(path), multi_line=True)
    assert sorted(r["a"] for r in df.collect()) == ["one\ntwo", "three"]


def test_spread_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = tables.read_table(spark, str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    assert tables.spread_out(one).rdd.getNumPartitions() == 8
    many = spark.range(0, 100, 1, 20)
    assert tables.spread_out(many) is many


def test_landing_keeps_file_and_run(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("x\n1\n")
    rows = sorted((r["file_name"], r["x"], r["run_id"]) for r in tables.land(spark, str(tmp_path), "r1").collect())
    assert rows == [("a.csv", "1", "r1"), ("b.csv", "1", "r1")]


def test_checkpoint_files(spark, tmp_path):
    assert tables.read_checkpoint_json(spark, str(tmp_path / "none")).isEmpty()
    state = {"status": "completed", "started_at": None, "completed_at": "2026-04-02T16:43:29+00:00",
             "output_hash": "", "metadata": {"rows": "20"}}
    (tmp_path / "r1.json").write_text(json.dumps({"profiling": state, "healing": state | {"status": "failed"}}, indent=2))
    (tmp_path / "r2.json").write_text("{ broken")
    rows = {r["stage"]: r for r in tables.read_checkpoint_json(spark, str(tmp_path)).collect()}
    assert rows["profiling"]["status"] == "completed" and rows["profiling"]["metadata"] == {"rows": "20"}
    assert set(rows) == {"profiling", "healing"}
    marks = tmp_path / "marks"
    marks.mkdir()
    (marks / "w.json").write_text(json.dumps({"sales": {"value": "2024", "updated_at": "now"}}))
    assert tuple(tables.read_watermark_json(spark, str(marks)).first()) == ("sales", "2024", "now")


def test_overwrite_replaces(spark, tmp_path):
    for n in (5, 3):
        tables.write_table(spark.range(n), str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 3


def test_upsert_table(spark):
    spark.sql("DROP TABLE IF EXISTS accounts")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    second = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    tables.upsert_table(spark, "accounts", first, ["k"], ["seq"])
    for _ in range(2):
        tables.upsert_table(spark, "accounts", second, ["k"], ["seq"])
        assert sorted((r["k"], r["v"]) for r in spark.table("accounts").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    counts = {r["table_name"]: r["row_count"] for r in
              tables.sink_row_counts({"accounts": tables.catalog_tables(spark)["accounts"]}).collect()}
    assert counts == {"accounts": 3, "_total_": 3}
    assert not [t for t in tables.catalog_tables(spark) if t.startswith("accounts_")]
    spark.sql("DROP TABLE accounts")


def test_json_lines(spark, tmp_path):
    events = spark.createDataFrame([("s", None, 5), ("s", "E", None)], "session_id string, error_type string, row_count int")
    tables.write_json_lines(runmeta.event_json_lines(events, events.columns), str(tmp_path / "log"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert [json.loads(x) for x in lines] == [{"session_id": "s", "error_type": "E"}, {"session_id": "s", "row_count": 5}]


# streams

def test_streams_pick_up_where_they_left(spark, tmp_path):
    source, target, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    schema = spark.range(0).schema
    for batch in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in batch], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.append_new(jobs.file_stream(spark, source, schema), target, offsets)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    source, target, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    schema = "id int, ts timestamp_ntz"
    for ids in ([5, 2, 2], [2, 3], [1, 4, 5]):  # late ones too
        rows = [(i, dt.datetime(2024, 1, 1, 0, i)) for i in ids]
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.drop_repeats(jobs.file_stream(spark, source, df.schema, files_per_batch=1), ["id"], target, offsets)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5]


def test_stream_findings_per_batch(spark, tmp_path):
    source, target, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    for i, rows in enumerate(([(1, None), (2, None)], [(3, "x"), (4, "y")])):
        df = spark.createDataFrame(rows, "k int, v string")
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.quality_batches(jobs.file_stream(spark, source, df.schema), target, offsets)
    found = {(r["batch_id"], r["rule"], r["column"]) for r in spark.read.parquet(target).collect()}
    assert found == {(0, "null_threshold", "v"), (1, "high_cardinality", "v")}


def test_report_of_a_batch(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 3.0)], "id int, price double")
    row = report(check(profile_columns(df))).first()
    assert (row["quality_score"], row["warning_count"], row["info_count"]) == (95, 1, 1)


def test_losses_of_a_cast_are_judged_without_the_dedup(spark, monkeypatch):
    """Repeats don't change whether a value is lost: the rows are shuffled for the result alone."""
    from tablecare.operators import clean
    from tablecare.plans import heal as plans

    judged, real = [], clean.cast_losses
    monkeypatch.setattr(clean, "cast_losses", lambda df, casts: (judged.append(df), real(df, casts))[1])
    df = spark.createDataFrame([(1, "10", "07")] * 2 + [(2, "20", "7")] * 2, "k int, code string, kept string")
    fixes = [plans.Fix("duplicate_threshold", "_all_", "", "dedup_exact")]
    fixes += [plans.Fix("type_consistency", c, "", "safe_cast", "double") for c in ("code", "kept")]
    out, uncast = plans.apply(df, fixes)
    assert uncast == {"kept"}
    assert sorted(map(tuple, out.collect())) == [(1, 10.0, "07"), (2, 20.0, "7")]
    assert "Aggregate" not in judged[0]._jdf.queryExecution().optimizedPlan().toString()
