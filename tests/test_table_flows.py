from __future__ import annotations

import datetime as dt
import hashlib
import re
from random import Random

import pytest
from pyspark.sql import functions as F

from snapdelta.plans import table_flows
from snapdelta.plans.steps import query_versions
from snapdelta.plans.table_flows import backup_table, put_over, restore_latest_table, restore_table
from snapdelta.sources import snapshots, state

RUNS = [dt.datetime(2024, 1, day, 10, 20, 30) for day in range(1, 6)]
STAMPS = [run.strftime("%Y%m%d%H%M%S") for run in RUNS]
KEY = ["id"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


@pytest.fixture
def backup(spark, tmp_path):
    def run(number, df=None, **texts):
        df = docs(spark, **texts) if df is None else df
        report = backup_table(spark, df, KEY, ["text"], str(tmp_path), RUNS[number])
        return {
            r["id"]: (
                r["file_hash"] and tuple(r["file_hash"]),
                r["backup_date"] and r["backup_date"][0],
                r["error"] and r["error"][0],
            )
            for r in report.collect()
        }

    return run


def stored(spark, path, version):
    restored = restore_table(spark, str(path), version, KEY)
    return {r["id"]: r["text"] for r in restored.rows.collect()}


def test_full_then_unchanged_then_changed(spark, tmp_path, backup):
    assert backup(0, a="1", b="2", c="3") == {k: ((sha(t), None), RUNS[0], None) for k, t in zip("abc", "123")}
    assert backup(1, a="1", b="2", c="3") == {k: ((sha(t), sha(t)), None, None) for k, t in zip("abc", "123")}
    assert backup(2, a="1", b="22", d="4") == {
        "a": ((sha("1"), sha("1")), None, None),
        "b": ((sha("22"), sha("2")), RUNS[2], None),
        "d": ((sha("4"), None), RUNS[2], None),
    }
    assert snapshots.stored_versions(spark, f"{tmp_path}/versions") == [STAMPS[0], STAMPS[2]]
    assert stored(spark, tmp_path, STAMPS[0]) == {"a": "1", "b": "2", "c": "3"}
    assert stored(spark, tmp_path, RUNS[2]) == {"b": "22", "d": "4"}
    lines = [r["line"] for r in query_versions(spark, str(tmp_path)).collect()]
    assert lines == ["2024-01-03 10:20:30", "2024-01-01 10:20:30"]
    key = [docs(spark, a="1").schema["id"]]
    hashes = dict(map(tuple, state.load_state(spark, f"{tmp_path}/state", key).collect()))
    assert hashes == {"a": sha("1"), "b": sha("22"), "c": sha("3"), "d": sha("4")}


def test_rows_without_key_or_content_fail_and_are_not_stored(spark, tmp_path, backup):
    frame = spark.createDataFrame([("a", "1"), ("b", None), (None, "3")], "id string, text string")
    missing = (None, None, "Required components missing.")
    assert backup(0, frame) == {"a": ((sha("1"), None), RUNS[0], None), "b": missing, None: missing}
    assert stored(spark, tmp_path, STAMPS[0]) == {"a": "1"}


def test_rows_come_back_whole(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1", 5, [1, 2])], "id string, text string, n int, xs array<int>")
    backup_table(spark, frame, KEY, ["text", "n"], str(tmp_path), RUNS[0])
    row = restore_latest_table(spark, str(tmp_path), KEY).rows.select(*frame.columns, "version").first()
    assert tuple(row) == ("a", "1", 5, [1, 2], STAMPS[0])


@pytest.mark.parametrize("kind", ["int", "double", "binary", "array", "struct"])
def test_content_of_any_type(spark, tmp_path, kind):
    frame = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, text string")
    pair = F.struct(F.col("text").cast("int").alias("a"), F.col("text").alias("b"))
    nested = {"array": F.split("text", ","), "struct": F.when(F.col("text").isNotNull(), pair)}
    frame = frame.withColumn("v", nested[kind] if kind in nested else F.col("text").cast(kind))
    backup_table(spark, frame, KEY, ["v"], str(tmp_path), RUNS[0])
    again = frame.withColumn("v", F.when(F.col("id") == "a", F.col("v")))
    report = {r["id"]: r for r in backup_table(spark, again, KEY, ["v"], str(tmp_path), RUNS[1]).collect()}
    assert report["a"]["backup_date"] is None and report["a"]["error"] is None
    assert report["b"]["error"] is not None and report["c"]["error"] is not None
    assert restore_latest_table(spark, str(tmp_path), KEY).rows.count() == 2


def test_two_runs_within_one_second(spark, tmp_path, backup):
    backup(0, a="1", b="1")
    backup(0, a="2", c="2")
    assert stored(spark, tmp_path, STAMPS[0]) == {"a": "2", "b": "1", "c": "2"}
    assert query_versions(spark, str(tmp_path)).count() == 1


def test_missing_version_and_empty_log(spark, tmp_path, backup):
    empty = restore_latest_table(spark, str(tmp_path), KEY)
    assert empty.error == "No backup dates found." and empty.entities.first().error[0] == "No backup dates found."
    backup(0, a="1")
    missing = restore_table(spark, str(tmp_path), "20200101000000", KEY)
    assert missing.rows is None and missing.error == "Backup date not found."
    entity = missing.entities.first()
    assert entity.error[0] == "Backup date not found." and entity.file_path[0] == f"{tmp_path}/versions/20200101000000"
    found = restore_latest_table(spark, str(tmp_path), KEY)
    assert found.error is None and [r.error for r in found.entities.collect()] == [None]


@pytest.mark.parametrize(("step", "dates"), [("append_log", 1), ("save_state", 2)])
def test_run_that_stopped_half_way_is_done_again(spark, tmp_path, backup, monkeypatch, step, dates):
    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table_flows, step, lost)
    with pytest.raises(RuntimeError):
        backup(0, a="1")
    monkeypatch.undo()
    assert backup(1, a="1") == {"a": ((sha("1"), None), RUNS[1], None)}
    assert stored(spark, tmp_path, STAMPS[1]) == {"a": "1"}
    assert query_versions(spark, str(tmp_path)).count() == dates


def test_few_changes_are_gathered(spark, tmp_path):
    frame = spark.range(20_000).select("id", F.col("id").cast("string").alias("text")).repartition(16)
    backup_table(spark, frame, KEY, ["text"], str(tmp_path), RUNS[0])
    again = frame.withColumn("text", F.when(F.col("id") < 50, "changed").otherwise(F.col("text")))
    backup_table(spark, again, KEY, ["text"], str(tmp_path), RUNS[1])
    rows = restore_latest_table(spark, str(tmp_path), KEY).rows
    assert rows.count() == 50
    assert len(rows.inputFiles()) == 1


@pytest.fixture
def in_files(spark, tmp_path):
    """Ten thousand rows in ten files, half of one file changed afterwards, and a store with a run before that."""
    frame = spark.range(0, 10_000, 1, 10).select("id", F.col("id").cast("string").alias("text"))
    frame.write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    backup_table(spark, source, KEY, ["text"], f"{tmp_path}/store", RUNS[0])
    changed = F.col("id").between(3000, 3499)
    return source.withColumn("text", F.when(changed, "changed").otherwise(F.col("text"))), f"{tmp_path}/store"


def test_only_files_with_changes_are_read_again(spark, in_files, monkeypatch):
    source, store = in_files
    written = []
    write = table_flows.write_version
    monkeypatch.setattr(table_flows, "write_version", lambda *args: written.append(args[3]) or write(*args))
    report = backup_table(spark, source, KEY, ["text"], store, RUNS[1])
    assert report.columns == ["id", "file_hash", "error", "backup_date"]
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"part-\d+", plan))) == 1
    rows = restore_latest_table(spark, store, KEY).rows
    assert rows.count() == 500 and rows.where("text != 'changed'").isEmpty()


RESHAPED = {
    "union": lambda df: df.unionByName(df.limit(0)),
    "distinct": lambda df: df.distinct(),
    "own column": lambda df: df.withColumn("_metadata", F.lit(1)),
}


@pytest.mark.parametrize("reshape", RESHAPED.values(), ids=RESHAPED)
def test_sources_without_file_names_are_read_whole(spark, in_files, reshape):
    source, store = in_files
    backup_table(spark, reshape(source), KEY, ["text"], store, RUNS[1])
    assert restore_latest_table(spark, store, KEY).rows.count() == 500


@pytest.mark.parametrize("keys", [1, 90, 1000])
def test_slices_of_any_size_shuffle_no_content(spark, in_files, monkeypatch, keys):
    source, store = in_files
    monkeypatch.setattr(table_flows, "SLICE_KEYS", keys if keys > 1 else 20)
    monkeypatch.setattr(table_flows, "GATHERED", 10)
    written = []
    write = table_flows.write_version
    monkeypatch.setattr(table_flows, "write_version", lambda *args: written.extend(args[3:]) or write(*args))
    many = source.withColumn("text", F.when(F.col("id").between(2500, 4500), "changed").otherwise(F.col("text")))
    backup_table(spark, many, KEY, ["text"], store, RUNS[1])
    slices = 0
    for rows in written[:3]:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert 1 <= len(exchanges) <= table_flows.AT_ONCE and all("BroadcastExchange" in line for line in exchanges)
        slices += len(exchanges)
    assert len(written) >= (2001 / max(keys, 20) - 1) / table_flows.AT_ONCE and slices > 1
    rows = restore_latest_table(spark, store, KEY).rows
    assert rows.count() == rows.select("id").distinct().count() == 2001 and rows.where("text != 'changed'").isEmpty()


def test_files_of_a_slice_are_bounded(spark, in_files, monkeypatch):
    source, store = in_files
    monkeypatch.setattr(table_flows, "SLICE_FILES", 3)
    everywhere = source.withColumn("text", F.when(F.col("id") % 500 == 7, "changed").otherwise(F.col("text")))
    parts = []
    slice_of = table_flows._slice
    monkeypatch.setattr(table_flows, "_slice", lambda *args: parts.append(args[3]) or slice_of(*args))
    backup_table(spark, everywhere, KEY, ["text"], store, RUNS[1])
    assert [len(names) for names in parts] == [3, 3, 3, 1]
    rows = restore_latest_table(spark, store, KEY).rows
    assert rows.count() == 519 and rows.where("text != 'changed'").isEmpty()


def test_files_with_changes_are_found_while_hashing(spark, in_files, monkeypatch):
    source, store = in_files
    collected = []
    monkeypatch.setattr(table_flows, "_parts", lambda touched, plain=table_flows._parts: collected.extend(touched) or plain(touched))
    backup_table(spark, source, KEY, ["text"], store, RUNS[1])
    assert len(collected) == 1 and "part-00003" in collected[0][0] and collected[0][2] == 500


STAMPED = "id string, text string, at timestamp"


def test_stamps_of_rows_make_many_versions_at_once(spark, tmp_path, monkeypatch):
    day = [dt.datetime(2023, 5, d, 1, 2, 3, 456) for d in range(1, 4)]
    frame = spark.createDataFrame([("a", "1", day[0]), ("b", "2", day[1]), ("c", "3", day[0]), ("d", "4", None)], STAMPED)
    report = backup_table(spark, frame, KEY, ["text"], str(tmp_path), RUNS[0], stamp_col="at")
    assert {r.id: r.backup_date[0] for r in report.collect()} == {"a": day[0], "b": day[1], "c": day[0], "d": RUNS[0]}
    assert report.columns == ["id", "file_hash", "error", "backup_date"]
    assert snapshots.stored_versions(spark, f"{tmp_path}/versions") == ["20230501010203", "20230502010203", STAMPS[0]]
    assert stored(spark, tmp_path, "20230501010203") == {"a": "1", "c": "3"} and stored(spark, tmp_path, STAMPS[0]) == {"d": "4"}
    assert [r.backup_date for r in query_versions(spark, str(tmp_path)).collect()] == [RUNS[0], day[1], day[0]]
    # A later run into a version of the past, and one that stops before its commit.
    again = spark.createDataFrame([("a", "9", day[0]), ("b", "2", day[2])], STAMPED)
    monkeypatch.setattr(snapshots, "touch", lambda spark, path, plain=snapshots.touch: 1 / 0 if "batch=" in path else plain(spark, path))
    with pytest.raises(ZeroDivisionError):
        backup_table(spark, again, KEY, ["text"], str(tmp_path), RUNS[1], stamp_col="at")
    monkeypatch.undo()
    assert stored(spark, tmp_path, "20230501010203") == {"a": "1", "c": "3"}
    backup_table(spark, again, KEY, ["text"], str(tmp_path), RUNS[1], stamp_col="at")
    assert stored(spark, tmp_path, "20230501010203") == {"a": "9", "c": "3"} and query_versions(spark, str(tmp_path)).count() == 3


def test_stamps_of_rows_from_files(spark, in_files):
    source, store = in_files
    stamped = source.withColumn("at.time", F.timestamp_seconds(1_700_000_000 + F.col("id") % 3 * 86_400))
    backup_table(spark, stamped, KEY, ["text"], store, RUNS[1], stamp_col="at.time")
    counts = [restore_table(spark, store, v, KEY).rows.count() for v in ("20231114221320", "20231115221320", "20231116221320")]
    assert sum(counts) == 500 and min(counts) >= 166


def test_a_source_with_columns_named_like_ours_comes_back_whole(spark, tmp_path):
    frame = docs(spark, a="1", b="2").selectExpr("*", "'v9' AS version", "'mine' AS content_hash")
    backup_table(spark, frame, KEY, ["text"], str(tmp_path), RUNS[0])
    again = frame.withColumn("text", F.when(F.col("id") == "b", "3").otherwise(F.col("text")))
    backup_table(spark, again, KEY, ["text"], str(tmp_path), RUNS[1])
    rows = restore_latest_table(spark, str(tmp_path), KEY).rows
    assert [r.asDict() for r in rows.collect()] == [{"id": "b", "text": "3", "version": "v9", "content_hash": "mine"}]
    with pytest.raises(ValueError, match="_snapdelta_hash"):
        backup_table(spark, frame.withColumn("_snapdelta_hash", F.lit(1)), KEY, ["text"], str(tmp_path), RUNS[2])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_nested_and_timestamp_changes_are_found_in_every_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        old = "array('a, b') AS x, map('k', 1) AS m, timestamp_seconds(1730611800) AS t"
        new = "array('a', 'b') AS x, map('k', 1) AS m, timestamp_seconds(1730611800) AS t"
        later = "array('a, b') AS x, map('k', 1) AS m, timestamp_seconds(1730615400) AS t"
        first = spark.sql(f"SELECT 1 AS id, {old} UNION ALL SELECT 2, {old} UNION ALL SELECT 3, {old}")
        backup_table(spark, first, KEY, ["x", "m", "t"], str(tmp_path), RUNS[0])
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        second = spark.sql(f"SELECT 1 AS id, {new} UNION ALL SELECT 2, {later} UNION ALL SELECT 3, {old}")
        report = backup_table(spark, second, KEY, ["x", "m", "t"], str(tmp_path), RUNS[1])
        assert sorted(r.id for r in report.where("backup_date IS NOT NULL").collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_put_over_replaces_same_keys_only(spark, rows):
    target = docs(spark, a="old", b="kept")
    restored = docs(spark, a="new", c="added").withColumn("version", F.lit("1"))
    assert rows(put_over(target, restored, KEY)) == [("a", "new"), ("b", "kept"), ("c", "added")]


@pytest.fixture
def target(spark, tmp_path):
    """A thousand rows in ten files of a hundred, and the names of the files."""
    path = f"{tmp_path}/some target"
    spark.range(0, 1000, 1, 10).select("id", F.concat(F.lit("old"), "id").alias("text"), F.lit(1).alias("n")).write.parquet(path)
    return path, lambda: {p.name for p in (tmp_path / "some target").glob("*.parquet")}


def contents(spark, path):
    return {r.id: (r.text, r.n) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize(("keys", "files"), [(1_000_000, 1000), (30, 1000), (1_000_000, 2)])
def test_restoring_into_a_target_replaces_the_files_concerned(spark, target, monkeypatch, keys, files):
    monkeypatch.setattr(table_flows, "SLICE_KEYS", keys)
    monkeypatch.setattr(table_flows, "SLICE_FILES", files)
    path, names = target
    expected, before = contents(spark, path), names()
    ids = [5, *range(290, 410), 999, 1000, 2000]
    restored = spark.createDataFrame([(i, f"new{i}", 2, "extra") for i in ids], "id long, text string, n int, version string")
    replaced = table_flows.restore_into(spark, path, restored, ["id"])
    expected |= {i: (f"new{i}", 2) for i in ids}
    rows = spark.read.parquet(path)
    assert contents(spark, path) == expected and rows.count() == len(expected) and rows.columns == ["id", "text", "n"]
    assert len(replaced) == 5 and len(before & names()) == 5
    assert table_flows.restore_into(spark, path, restored.limit(0), ["id"]) == [] and contents(spark, path) == expected


@pytest.mark.parametrize("step", ["write_lines", "move_files", "remove_file", "remove"])
def test_a_restore_that_stopped_is_finished_or_undone(spark, target, monkeypatch, step):
    path, _ = target
    expected = contents(spark, path)
    restored = spark.createDataFrame([(5, "new", 2), (950, "new", 2)], "id long, text string, n int")
    plain, calls = getattr(table_flows.folders, step), []

    def lost(*args):
        calls.append(args)
        if len(calls) == (2 if step == "remove_file" else 1):
            raise RuntimeError("lost")
        return plain(*args)

    monkeypatch.setattr(table_flows.folders, step, lost)
    with pytest.raises(RuntimeError):
        table_flows.restore_into(spark, path, restored, ["id"])
    monkeypatch.undo()
    table_flows.finish_restore(spark, path)
    if step != "write_lines":
        expected |= {5: ("new", 2), 950: ("new", 2)}
    rows = spark.read.parquet(path)
    assert contents(spark, path) == expected and rows.count() == 1000


def test_restoring_into_a_partitioned_target(spark, tmp_path):
    path = f"{tmp_path}/by day"
    frame = spark.range(100).selectExpr("id", "id % 3 AS day", "'old' AS text")
    frame.write.partitionBy("day").parquet(path)
    restored = spark.createDataFrame([(4, 1, "new"), (200, 7, "added")], "id long, day long, text string")
    assert len(table_flows.restore_into(spark, path, restored, ["id"], ["day"])) == 1
    found = {r.id: (r.day, r.text) for r in spark.read.parquet(path).collect()}
    assert found == {k: (k % 3, "old") for k in range(100)} | {4: (1, "new"), 200: (7, "added")}


def test_composite_key(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "conv long, turn long, text string")
    backup_table(spark, frame, ["conv", "turn"], ["text"], str(tmp_path), RUNS[0])
    again = frame.withColumn("text", F.when(F.col("turn") == 2, "bb").otherwise(F.col("text")))
    backup_table(spark, again, ["conv", "turn"], ["text"], str(tmp_path), RUNS[1])
    rows = restore_latest_table(spark, str(tmp_path), ["conv", "turn"]).rows
    assert [tuple(r) for r in rows.select("conv", "turn", "text").collect()] == [(1, 2, "bb")]


def test_many_runs_agree_with_a_dictionary(spark, tmp_path):
    random = Random(7)
    source, known = {}, {}
    key = [docs(spark, a="1").schema["id"]]
    for run in range(5):
        for name in random.sample(range(40), 12):
            source[f"k{name}"] = str(random.randrange(4))
        for name in random.sample(sorted(source), 3):
            del source[name]
        expected = {k: t for k, t in source.items() if known.get(k) != sha(t)}
        known.update({k: sha(t) for k, t in expected.items()})
        backup_table(spark, docs(spark, **source), KEY, ["text"], str(tmp_path), RUNS[run])
        assert stored(spark, tmp_path, RUNS[run]) == expected
        assert dict(map(tuple, state.load_state(spark, f"{tmp_path}/state", key).collect())) == known
