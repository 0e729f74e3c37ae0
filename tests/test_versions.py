from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from snapdelta.operators.versions import (
    check_versions,
    last_wins,
    latest_version,
    list_versions,
    log_add,
    version_lines,
    versions_component,
)

from snapdelta.plans import steps
from snapdelta.plans.stages import Pipeline

DAYS = [dt.datetime(2022, 1, 2), dt.datetime(2022, 1, 1), dt.datetime(2022, 1, 3)]
NEWEST_FIRST = sorted(DAYS, reverse=True)


def log(spark, *dates):
    return spark.createDataFrame([(d,) for d in dates], "backup_date timestamp")


def test_log_add_is_a_set_insert(spark, rows):
    assert rows(log_add(log(spark, *DAYS), log(spark, DAYS[0], DAYS[0]))) == rows(log(spark, *DAYS))


def test_list_is_newest_first(spark):
    assert [r[0] for r in list_versions(log(spark, *DAYS, DAYS[0])).collect()] == NEWEST_FIRST


def test_component_holds_all_dates_and_is_empty_not_null(spark):
    assert versions_component(log(spark, *DAYS)).first()["backup_dates"]["dates"] == NEWEST_FIRST
    assert versions_component(log(spark)).first()["backup_dates"]["dates"] == []


def test_list_on_entities_through_a_stage(spark):
    """The two cases of a list on an entity: unsorted dates, and none."""
    entities = spark.createDataFrame([("a", ("p",)), ("b", None)], "entity_id string, file_path struct<file_path:string>")
    for dates, expected in ((log(spark, *DAYS, DAYS[0]), NEWEST_FIRST), (log(spark), [])):
        result = Pipeline([steps.list_versions(dates)]).run(entities)
        assert {r.entity_id: r.backup_dates.dates for r in result.collect()} == {"a": expected, "b": expected}
        assert [r.error for r in result.collect()] == [None, None]


def test_dates_within_one_second_print_twice(spark):
    twins = [dt.datetime(2022, 1, 1, 5, 6, 7, n) for n in (1, 2)]
    lines = version_lines(log(spark, *DAYS, *twins))
    assert [(r["position"], r["line"]) for r in lines.collect()] == [
        (1, "2022-01-03 00:00:00"),
        (2, "2022-01-02 00:00:00"),
        (3, "2022-01-01 05:06:07"),
        (4, "2022-01-01 05:06:07"),
        (5, "2022-01-01 00:00:00"),
    ]


def test_positions_over_many_days(spark):
    dates = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 7919).alias("backup_date"))
    lines = version_lines(dates).collect()
    assert [r["position"] for r in lines] == list(range(1, 5001))
    assert [r["backup_date"] for r in lines] == sorted((r["backup_date"] for r in lines), reverse=True)


def test_latest(spark):
    row = latest_version(log(spark, *DAYS)).first()
    assert row["backup_date"] == NEWEST_FIRST[0] and row["_result"]["is_success"]


def test_latest_of_nothing_fails(spark):
    row = latest_version(log(spark)).first()
    assert row["backup_date"] is None and tuple(row["_result"]) == (False, "No backup dates found.")


def test_check_versions(spark, rows):
    requests = spark.createDataFrame([("1",), ("2",)], "version string")
    stored = spark.createDataFrame([("1", "x"), ("1", "y")], "version string, path string")
    checked = check_versions(requests, stored).select("version", "_result.error_message")
    assert rows(checked) == [("1", None), ("2", "Backup date not found.")]


def test_last_copy_of_a_path_wins_and_others_stay(spark, rows):
    copies = spark.createDataFrame(
        [("v1", "a", 1, "old"), ("v1", "a", 2, "new"), ("v1", "b", 1, "only"), ("v2", "a", 1, "other")],
        "version string, path string, seq int, content string",
    )
    assert rows(last_wins(copies, ["version", "path"], ["seq"])) == [
        ("v1", "a", 2, "new"),
        ("v1", "b", 1, "only"),
        ("v2", "a", 1, "other"),
    ]
