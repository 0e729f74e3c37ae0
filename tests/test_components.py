from __future__ import annotations

from pyspark.sql import functions as F

from snapdelta.operators.components import (
    component_columns,
    declare,
    get_component,
    has_component,
    latest,
    list_entities,
    missing_component,
    populated,
    seed_entities,
    set_component,
    upsert,
    with_component,
)

KEY = ["id"]
MARK = "struct<m:string>"


def entities(spark, *data):
    frame = spark.createDataFrame(list(data), "id string, text string")
    return frame.select("id", F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("m"))).alias("a"))


def test_set_replaces_the_whole_component(spark, rows):
    df = set_component(entities(spark, ("x", "old"), ("y", None)), "a", F.struct(F.lit("new").alias("m")))
    assert rows(df.select("id", "a.m")) == [("x", "new"), ("y", "new")]


def test_set_on_some_rows_keeps_the_others(spark, rows):
    df = set_component(entities(spark, ("x", "old"), ("y", None)), "a", F.struct(F.lit("new").alias("m")), F.col("id") == "y")
    assert rows(df.select("id", "a.m")) == [("x", "old"), ("y", "new")]


def test_set_adds_a_component_that_was_not_there(spark, rows):
    df = set_component(entities(spark, ("x", "o"), ("y", None)), "b", F.struct(F.lit(1).alias("n")), F.col("id") == "x")
    assert rows(df.select("id", "b.n")) == [("x", 1), ("y", None)]


def test_declare_adds_typed_nulls_once(spark):
    df = declare(declare(entities(spark, ("x", "o")), {"b": MARK, "a": MARK}), {"b": MARK})
    assert component_columns(df, KEY) == ["a", "b"]
    assert df.schema["b"].dataType.simpleString() == MARK
    assert df.first()["b"] is None


def test_null_field_is_not_an_absent_component(spark, rows):
    df = set_component(entities(spark, ("x", None)), "a", F.struct(F.lit(None).cast("string").alias("m")))
    assert rows(df.select(has_component("a"))) == [(True,)]


def test_get_returns_each_entitys_own_or_null(spark, rows):
    table = spark.createDataFrame([("x", 1), ("y", 2)], "id string, n int")
    keys = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    assert rows(get_component(keys, table, KEY)) == [("x", 1), ("y", 2), ("z", None)]


def test_has_and_missing_are_complements(spark, rows):
    keys = spark.createDataFrame([("x",), ("y",), (None,)], "id string")
    table = spark.createDataFrame([("x", 1), ("x", 2)], "id string, n int")
    assert rows(with_component(keys, table, KEY)) == [("x",)]
    assert rows(missing_component(keys, table, KEY)) == [("y",), (None,)]


def test_list_entities_once_each(spark, rows):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "id string")
    assert rows(list_entities([a, b], KEY)) == [("x",), ("y",), ("z",)]


def test_populated_drops_entities_without_components(spark, rows):
    assert rows(populated(entities(spark, ("x", "o"), ("y", None)), KEY).select("id")) == [("x",)]
    assert populated(spark.createDataFrame([("x",)], "id string"), KEY).isEmpty()


def test_latest_takes_the_last_write_even_if_null(spark, rows):
    feed = spark.createDataFrame(
        [("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c"), ("y", 3, None), ("y", 2, "d")], "id string, seq int, v string"
    )
    assert rows(latest(feed, KEY, ["seq"], ["v"])) == [("x", "b"), ("y", None)]


def test_latest_breaks_ties_by_the_next_column(spark, rows):
    feed = spark.createDataFrame([("x", 1, 1, "a"), ("x", 1, 2, "b")], "id string, t int, seq int, v string")
    assert rows(latest(feed, KEY, ["t", "seq"], ["v", "seq"])) == [("x", "b", 2)]


def test_latest_with_one_key_owning_most_rows(spark, rows):
    feed = spark.range(20_000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("seq"),
        F.col("id").alias("v"),
    )
    result = latest(feed, KEY, ["seq"], ["v"])
    assert rows(result.where("id = 'hot'")) == [("hot", 19_999)]
    assert result.count() == 6_668


def test_upsert_lets_a_null_win_and_keeps_the_rest(spark, rows):
    base = spark.createDataFrame([("x", "1", "p"), ("y", "2", "q")], "id string, v string, w string")
    updates = spark.createDataFrame([("y", None, "r"), ("z", "3", None)], "id string, v string, w string")
    assert rows(upsert(base, updates, KEY)) == [("x", "1", "p"), ("y", None, "r"), ("z", "3", None)]


def test_seed_entities(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "folder string")
    seeds = seed_entities(df, F.concat(F.lit("/"), F.col("folder")), F.upper("_path"))
    assert rows(seeds.select("entity_id", "file_path.file_path")) == [("/A", "/a"), ("/B", "/b")]
