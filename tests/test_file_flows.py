from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from snapdelta import Pipeline
from snapdelta.plans.file_flows import (
    STATE_KEY,
    backup_files,
    backup_stages,
    discover,
    export_store,
    hash_files,
    import_store,
    restore_files,
    restore_latest_files,
    store_files,
)
from snapdelta.plans.steps import query_versions
from snapdelta.sources.log import append_log, load_log
from snapdelta.sources.state import load_state
from tests.test_files import TREE, contents, grow

RUNS = [dt.datetime(2024, 1, day, 10, 20, 30, 400) for day in range(1, 6)]
STAMPS = ["20240101102030", "20240102102030", "20240103102030", "20240104102030", "20240105102030"]
ENTITY = (
    "entity_id string, file_path struct<file_path:string>, "
    "file_hash struct<current_hash:string,previous_hash:string>, backup_date struct<backup_date:timestamp>"
)


def sha(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


@pytest.fixture
def place(spark, tmp_path):
    """Source tree, destination and store of one test, with the calls bound to them."""

    class Place:
        source, destination, store, target = (tmp_path / n for n in ("source", "versions", "store", "restored"))

        def backup(self, run, **options):
            report = backup_files(spark, str(self.source), str(self.destination), str(self.store), RUNS[run], **options)
            return {
                os.path.relpath(r["file_path"][0], self.source): (
                    r["file_hash"] and tuple(r["file_hash"]),
                    r["backup_date"] and r["backup_date"][0],
                    r["error"] and r["error"][0],
                )
                for r in report.collect()
            }

        def state(self):
            rows = load_state(spark, f"{self.store}/state", STATE_KEY).collect()
            return {os.path.relpath(r["path"], self.source): r["content_hash"] for r in rows}

        def lines(self):
            return [r["line"] for r in query_versions(spark, str(self.store)).collect()]

    Place.source.mkdir()
    return Place()


SEED = (None, None, "Required components missing.")


def test_first_run_copies_everything(place):
    grow(place.source, TREE)
    report = place.backup(0)
    assert report == {n: ((sha(c), None), RUNS[0], None) for n, c in TREE.items()} | {".": SEED}
    assert contents(place.destination) == {f"{STAMPS[0]}/{n}": c for n, c in TREE.items()}
    assert place.state() == {n: sha(c) for n, c in TREE.items()}
    assert place.lines() == ["2024-01-01 10:20:30"]


def test_unchanged_run_writes_nothing(place):
    grow(place.source, TREE)
    place.backup(0)
    report = place.backup(1)
    assert report == {n: ((sha(c), sha(c)), None, None) for n, c in TREE.items()} | {".": SEED}
    assert os.listdir(place.destination) == [STAMPS[0]]
    assert place.lines() == ["2024-01-01 10:20:30"]


def test_change_addition_and_deletion(place):
    grow(place.source, {"keep": b"1", "change": b"2", "delete": b"3"})
    place.backup(0)
    (place.source / "delete").unlink()
    grow(place.source, {"change": b"22", "d/new": b"4"})
    report = place.backup(1)
    assert report == {
        ".": SEED,
        "keep": ((sha(b"1"), sha(b"1")), None, None),
        "change": ((sha(b"22"), sha(b"2")), RUNS[1], None),
        "d/new": ((sha(b"4"), None), RUNS[1], None),
    }
    assert contents(place.destination / STAMPS[1]) == {"change": b"22", "d/new": b"4"}
    assert place.state() == {"keep": sha(b"1"), "change": sha(b"22"), "delete": sha(b"3"), "d/new": sha(b"4")}
    assert place.lines() == ["2024-01-02 10:20:30", "2024-01-01 10:20:30"]


def test_files_stamped_with_their_own_time(spark, place):
    grow(place.source, {"a": b"1", "d/b": b"2", "c": b"3"})
    moments = {"a": 1_600_000_000, "d/b": 1_700_000_000, "c": 1_600_000_000}
    for name, second in moments.items():
        os.utime(place.source / name, (second, second))
    report = place.backup(0, stamp_col="file_time.modified")
    assert {n: r[1] and r[1].timestamp() for n, r in report.items() if n != "."} == moments and report["."] == SEED
    assert contents(place.destination) == {"20200913122640/a": b"1", "20200913122640/c": b"3", "20231114221320/d/b": b"2"}
    assert place.lines() == ["2023-11-14 22:13:20", "2020-09-13 12:26:40"]
    grow(place.source, {"a": b"11"})
    os.utime(place.source / "a", (1_700_000_000, 1_700_000_000))
    place.backup(1, stamp_col="file_time.modified")
    assert contents(place.destination / "20231114221320") == {"a": b"11", "d/b": b"2"} and len(place.lines()) == 2


def test_restore_gives_one_version_only(spark, place):
    grow(place.source, {"keep": b"1", "change": b"2"})
    place.backup(0)
    grow(place.source, {"change": b"22"})
    place.backup(1)
    restore_latest_files(spark, str(place.store), str(place.destination), str(place.target))
    assert contents(place.target) == {"change": b"22"}
    grow(place.target, {"other": b"9"})
    report = restore_files(spark, str(place.destination), RUNS[0], str(place.target))
    assert contents(place.target) == {"keep": b"1", "change": b"2", "other": b"9"}
    assert report.where("error is not null").isEmpty()


def test_restore_of_a_missing_version_reports_it(spark, place):
    report = restore_files(spark, str(place.destination), "20200101000000", str(place.target))
    assert [r[0] for r in report.select("error.error_message").collect()] == ["Backup date not found."]
    assert not place.target.exists()


def test_restore_latest_with_an_empty_log(spark, place):
    report = restore_latest_files(spark, str(place.store), str(place.destination), str(place.target))
    assert [r[0] for r in report.select("error.error_message").collect()] == ["No backup dates found."]


def test_restore_latest_when_the_newest_version_is_gone(spark, place):
    append_log(spark, f"{place.store}/log", spark.createDataFrame([(RUNS[0],)], "backup_date timestamp"))
    report = restore_latest_files(spark, str(place.store), str(place.destination), str(place.target))
    assert [r[0] for r in report.select("error.error_message").collect()] == ["Backup date not found."]


def test_failed_restore_of_a_file_is_reported_and_others_go_on(spark, place):
    grow(place.destination / STAMPS[0], {"a/x": b"1", "b": b"2"})
    grow(place.target, {"a": b"a file in place of the folder"})
    report = restore_files(spark, str(place.destination), STAMPS[0], str(place.target))
    messages = [r[0] for r in report.select("error.error_message").collect() if r[0]]
    assert len(messages) == 1 and messages[0].startswith("Failed to restore files: ")
    assert contents(place.target)["b"] == b"2"


def test_two_runs_within_one_second_share_a_version(spark, place):
    grow(place.source, {"a": b"1", "b": b"1"})
    backup_files(spark, str(place.source), str(place.destination), str(place.store), dt.datetime(2024, 1, 1, 0, 0, 0, 1))
    grow(place.source, {"a": b"2", "c": b"2"})
    backup_files(spark, str(place.source), str(place.destination), str(place.store), dt.datetime(2024, 1, 1, 0, 0, 0, 2))
    assert contents(place.destination) == {f"20240101000000/{n}": c for n, c in {"a": b"2", "b": b"1", "c": b"2"}.items()}
    assert place.lines() == ["2024-01-01 00:00:00"] * 2


def test_failed_copy_is_reported_and_kept_in_the_state(place):
    grow(place.source, {"a/x": b"1", "b": b"2"})
    grow(place.destination / STAMPS[0], {"a": b"a file in place of the folder"})
    report = place.backup(0)
    assert report["a/x"][1] == RUNS[0] and report["a/x"][2].startswith("Failed to store file version: ")
    assert place.state() == {"a/x": sha(b"1"), "b": sha(b"2")}
    assert place.backup(1)["a/x"] == ((sha(b"1"), sha(b"1")), None, None)


def test_failed_copy_is_tried_again_on_request(place):
    grow(place.source, {"a/x": b"1", "b": b"2"})
    grow(place.destination / STAMPS[0], {"a": b"a file in place of the folder"})
    place.backup(0, only_written=True)
    assert place.state() == {"b": sha(b"2")}
    assert place.backup(1, only_written=True)["a/x"] == ((sha(b"1"), None), RUNS[1], None)
    assert contents(place.destination / STAMPS[1]) == {"a/x": b"1"}


def test_unreadable_file_is_an_error_row(place):
    grow(place.source, {"good": b"1"})
    (place.source / "broken").symlink_to(place.source / "nowhere")
    report = place.backup(0)
    assert report["broken"] == SEED and report["good"][1] == RUNS[0]
    assert place.state() == {"good": sha(b"1")}


def test_missing_source_is_an_exception(spark, place):
    with pytest.raises(NotADirectoryError):
        backup_files(spark, f"{place.source}/none", str(place.destination), str(place.store))
    assert load_log(spark, f"{place.store}/log").isEmpty()


def test_run_without_a_given_time_takes_the_present(spark, place):
    grow(place.source, {"a": b"1"})
    before = dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)
    backup_files(spark, str(place.source), str(place.destination), str(place.store))
    [version] = os.listdir(place.destination)
    assert before <= dt.datetime.strptime(version, "%Y%m%d%H%M%S") <= dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def test_four_stages():
    names = [s.name for s in backup_stages("/s", "/d", "/t", None, RUNS[0])]
    assert names == ["File Discovery", "Hash Calculation", "Backup Decision", "Backup Execution"]


def test_seed_without_components_vanishes_and_files_are_copied(spark, place):
    grow(place.source, {"a": b"1"})
    seed = spark.createDataFrame([("seed", None)], "entity_id string, file_path struct<file_path:string>")
    state = load_state(spark, f"{place.store}/state", STATE_KEY)
    stages = backup_stages(str(place.source), str(place.destination), f"{place.destination}/.staging", state, RUNS[0])
    report = Pipeline(stages).run(seed)
    assert [(r["file_path"][0], r["error"]) for r in report.collect()] == [(str(place.source / "a"), None)]
    assert contents(place.destination) == {f"{STAMPS[0]}/a": b"1"}


def test_discovery_runs_once_per_entity(spark, place):
    grow(place.source, {"a": b"1", "b": b"2"})
    for copies in (0, 1, 3):
        given = spark.range(copies).select(F.col("id").cast("string").alias("entity_id"))
        found = discover(str(place.source))(given)
        assert found.count() == 2 * copies == found.select("entity_id").distinct().count()


def entity(spark, *data):
    return spark.createDataFrame(list(data), ENTITY)


def result_of(df):
    return tuple(df.first()["_result"])


def test_hash_stage(spark, place):
    grow(place.source, {"a": b"Test Content"})
    path = str(place.source / "a")
    state = spark.createDataFrame([(path, "old")], "path string, content_hash string")
    df = hash_files(state)(entity(spark, ("e", (path,), None, None)))
    assert tuple(df.first()["file_hash"]) == (sha(b"Test Content"), "old") and result_of(df) == (True, None)
    df = hash_files(state.limit(0))(entity(spark, ("e", (path,), None, None)))
    assert tuple(df.first()["file_hash"]) == (sha(b"Test Content"), None)
    assert result_of(hash_files(state)(entity(spark, ("e", None, None, None)))) == (False, "FilePathComponent missing.")
    assert result_of(hash_files(state)(entity(spark, ("e", (None,), None, None)))) == (False, "Failed to compute hash.")


def test_execution_stage(spark, place):
    grow(place.source, {"a": b"1"})
    store = store_files(str(place.source), str(place.destination), f"{place.destination}/.staging")
    path = str(place.source / "a")
    assert result_of(store(entity(spark, ("e", (path,), ("h", None), None)))) == (True, None)
    assert not (place.destination / STAMPS[0]).exists()
    assert result_of(store(entity(spark, ("e", None, None, (RUNS[0],))))) == (False, "FilePathComponent missing.")
    df = store(entity(spark, ("e", (path,), ("before it changed", None), (RUNS[0],))))
    assert tuple(df.first()["file_hash"]) == (sha(b"1"), None)
    assert contents(place.destination) == {f"{STAMPS[0]}/a": b"1"}
    gone = store(entity(spark, ("e", (f"{path}/none",), ("h", None), (RUNS[0],)))).first()["_result"]
    assert not gone[0] and gone[1].startswith("Failed to store file version: ")


def test_json_state_and_versions_are_taken_over(spark, place, tmp_path):
    grow(place.source, {"same": b"1", "changed": b"22"})
    grow(place.destination / STAMPS[0], {"same": b"1", "changed": b"2"})
    known = {str(place.source / "same"): sha(b"1"), str(place.source / "changed"): sha(b"2")}
    (tmp_path / "hashes.json").write_text(json.dumps(known))
    (tmp_path / "dates.json").write_text('["2024-01-01T10:20:30.0004Z"]')
    import_store(spark, f"{tmp_path}/hashes.json", f"{tmp_path}/dates.json", str(place.store))
    restore_latest_files(spark, str(place.store), str(place.destination), str(place.target))
    assert contents(place.target) == {"same": b"1", "changed": b"2"}
    report = place.backup(1)
    assert report["same"][1] is None and report["changed"] == ((sha(b"22"), sha(b"2")), RUNS[1], None)

    export_store(spark, str(place.store), f"{tmp_path}/hashes", f"{tmp_path}/dates")
    texts = {n: "".join(p.read_text() for p in (tmp_path / n).glob("*.txt")) for n in ("hashes", "dates")}
    assert json.loads(texts["hashes"]) == known | {str(place.source / "changed"): sha(b"22")}
    assert json.loads(texts["dates"]) == ["2024-01-01T10:20:30.000400Z", "2024-01-02T10:20:30.000400Z"]


def test_taking_over_nothing_leaves_an_empty_store(spark, place, tmp_path):
    import_store(spark, f"{tmp_path}/none.json", f"{tmp_path}/none.json", str(place.store))
    assert place.state() == {} and place.lines() == []
