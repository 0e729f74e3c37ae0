from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from snapdelta.operators.delta import changed, merge_state, with_prior
from snapdelta.plans.steps import decide

RUN = dt.datetime(2024, 1, 1, 12, 0, 0)


def hashes(spark, *data):
    frame = spark.createDataFrame(list(data), "id string, current_hash string, previous_hash string")
    has = F.col("current_hash").isNotNull() | F.col("previous_hash").isNotNull()
    return frame.select("id", F.when(has, F.struct("current_hash", "previous_hash")).alias("file_hash"))


def decided(df):
    return {
        r["id"]: (r["backup_date"] and r["backup_date"][0], r["_result"]["error_message"]) for r in df.collect()
    }


def test_prior_is_looked_up_by_exact_key(spark, rows):
    current = spark.createDataFrame([("a", "h"), ("A", "h"), (None, "h")], "id string, current_hash string")
    state = spark.createDataFrame([("a", "old"), ("gone", "x")], "id string, content_hash string")
    assert rows(with_prior(current, state, ["id"])) == [("A", "h", None), ("a", "h", "old"), (None, "h", None)]


def test_changed_is_null_safe(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, "a"), (None, None)], "c string, p string")
    assert [r[0] for r in frame.select(changed(F.col("c"), F.col("p"))).collect()] == [False, True, True, True, False]


def test_new_and_changed_are_stamped_and_unchanged_are_not(spark):
    rows = hashes(spark, ("new", "h", None), ("changed", "h", "g"), ("same", "h", "h"))
    assert decided(decide(("file_hash",), RUN)(rows)) == {"new": (RUN, None), "changed": (RUN, None), "same": (None, None)}


def test_missing_components_fail(spark):
    rows = hashes(spark, ("empty", None, None))
    assert decided(decide(("file_hash",), RUN)(rows)) == {"empty": (None, "Required components missing.")}


def test_stamp_may_be_a_column(spark):
    rows = hashes(spark, ("a", "h", None), ("b", "h", None))
    rows = rows.withColumn("seen", F.when(F.col("id") == "a", F.lit(RUN)).otherwise(F.lit(dt.datetime(2024, 1, 2))))
    stamped = decide(("file_hash",), stamp_col="seen")(rows)
    assert decided(stamped) == {"a": (RUN, None), "b": (dt.datetime(2024, 1, 2), None)}


def test_earlier_stamp_stays_on_unchanged_rows(spark):
    rows = hashes(spark, ("same", "h", "h")).withColumn("backup_date", F.struct(F.lit(RUN).alias("backup_date")))
    assert decided(decide(("file_hash",), dt.datetime(2025, 1, 1))(rows)) == {"same": (RUN, None)}


def test_merge_replaces_adds_and_never_removes(spark, rows):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content_hash string")
    updates = spark.createDataFrame([("b", "3"), ("c", "4")], "id string, content_hash string")
    assert rows(merge_state(state, updates, ["id"])) == [("a", "1"), ("b", "3"), ("c", "4")]
