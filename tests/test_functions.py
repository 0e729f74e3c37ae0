from __future__ import annotations

import datetime as dt
import hashlib
import os.path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapdelta.functions import (
    content_hash,
    display_date,
    encode,
    entity_id,
    fail,
    first_failure,
    ok,
    parent_path,
    relative_path,
    require,
    target_path,
    timestamp_literal,
    version_stamp,
)
from snapdelta.functions.stamps import micros, stamp_of, stamp_of_micros


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hash_is_sha256_in_lower_case_hex(spark):
    assert value(spark, content_hash(F.lit("Hello, World!"))) == hashlib.sha256(b"Hello, World!").hexdigest()


def test_hash_of_bytes_and_of_nothing(spark):
    assert value(spark, content_hash(F.lit(bytearray(b"\x00\xff")))) == hashlib.sha256(b"\x00\xff").hexdigest()
    assert value(spark, content_hash(F.lit(""))) == hashlib.sha256(b"").hexdigest()


def test_hash_of_null_is_null(spark):
    assert value(spark, content_hash(F.lit(None).cast("string"))) is None


def test_hash_of_several_columns_keeps_them_apart(spark):
    frame = spark.createDataFrame(
        [("ab", "c"), ("a", "bc"), ("abc", None), (None, "abc"), ("abc", ""), (None, None)], "x string, y string"
    )
    assert frame.select(content_hash("x", "y").alias("h")).distinct().count() == 6


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.none() | st.text("-;:1a"), st.none() | st.text("-;:1a")), max_size=20))
def test_encoding_is_injective(spark, pairs):
    frame = spark.createDataFrame(list(set(pairs)), "x string, y string")
    assert frame.select(encode("x", "y").alias("e")).distinct().count() == len(set(pairs))


def test_entity_ids_are_stable_and_unique(spark):
    ids = spark.range(1000).select(entity_id("id").alias("e"))
    assert ids.distinct().count() == 1000
    assert ids.exceptAll(spark.range(1000).select(entity_id("id"))).isEmpty()
    assert value(spark, entity_id(F.lit("a"), F.lit("b"))) != value(spark, entity_id(F.lit("ab")))


def test_relative_path_agrees_with_the_standard_library(spark):
    pairs = [
        ("/data/src/a.txt", "/data/src"),
        ("/data/src/deep/er/a.txt", "/data/src/"),
        ("/data/src", "/data/src"),
        ("/data/srcs/a.txt", "/data/src"),
        ("/data/a.txt", "/data/src/x"),
        ("/other/a.txt", "/data/src"),
        ("/data/src/a [b] (c)+$.txt", "/data/src"),
        ("/data/s.c/a", "/data/s.c"),
    ]
    frame = spark.createDataFrame(pairs, "path string, root string")
    for row in frame.withColumn("r", relative_path(F.col("path"), F.col("root"))).collect():
        assert row["r"] == os.path.relpath(row["path"], row["root"])
    for path, root in pairs:
        assert value(spark, relative_path(F.lit(path), root)) == os.path.relpath(path, root)


SEGMENTS = st.lists(st.sampled_from(["a", "b", "ab", "a b", ".x", "(y)"]), min_size=1, max_size=4)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(SEGMENTS, SEGMENTS), min_size=1, max_size=10))
def test_relative_path_of_any_two_paths(spark, pairs):
    paths = [("/" + "/".join(p), "/" + "/".join(r)) for p, r in pairs]
    frame = spark.createDataFrame(paths, "path string, root string")
    for row in frame.withColumn("r", relative_path(F.col("path"), F.col("root"))).collect():
        assert row["r"] == os.path.relpath(row["path"], row["root"])


def test_target_and_parent_path(spark):
    target = target_path("/dest/", F.lit("20220101000000"), F.lit("a/b.txt"))
    assert value(spark, target) == "/dest/20220101000000/a/b.txt"
    assert value(spark, parent_path(target)) == "/dest/20220101000000/a"
    assert value(spark, parent_path(F.lit("b.txt"))) == ""


def test_stamps_cut_fractions(spark):
    moment = dt.datetime(2022, 1, 2, 3, 4, 5, 999999)
    assert value(spark, version_stamp(timestamp_literal(moment))) == "20220102030405" == stamp_of(moment)
    assert value(spark, display_date(timestamp_literal(moment))) == "2022-01-02 03:04:05"
    assert stamp_of_micros(micros(moment)) == "20220102030405"


def test_stamp_is_utc_for_any_offset():
    east = dt.timezone(dt.timedelta(hours=5))
    assert stamp_of(dt.datetime(2022, 1, 1, 2, 0, tzinfo=east)) == "20211231210000"


def test_status(spark):
    assert tuple(value(spark, ok())) == (True, None)
    assert tuple(value(spark, fail("broken"))) == (False, "broken")
    assert tuple(value(spark, fail(None))) == (False, None)
    assert tuple(value(spark, require(F.lit(True), "m"))) == (True, None)
    assert tuple(value(spark, require(F.lit(False), "m"))) == (False, "m")
    assert tuple(value(spark, require(F.lit(None).cast("boolean"), "m"))) == (False, "m")


def test_first_failure_wins(spark):
    assert tuple(value(spark, first_failure(ok(), fail("a"), fail("b")))) == (False, "a")
    assert tuple(value(spark, first_failure(ok(), ok()))) == (True, None)
