from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapdelta import Pipeline, Stage, clean, errors
from snapdelta.functions import fail, ok, require
from snapdelta.functions.status import RESULT
from snapdelta.operators.components import has_component, set_component

EXAMPLE = "struct<present:boolean>"


def entities(spark, **present):
    frame = spark.createDataFrame(list(present.items()), "entity_id string, p boolean")
    return frame.select("entity_id", F.when(F.col("p"), F.struct(F.lit(True).alias("present"))).alias("example"))


def needs_example(df):
    return df.withColumn(RESULT, require(has_component("example"), "Component missing."))


def always_fails(df):
    return df.withColumn(RESULT, fail("System failed intentionally."))


def succeeds(df):
    return df.withColumn(RESULT, ok())


def messages(df):
    return {r[0]: r[1] for r in df.select("entity_id", "error.error_message").collect()}


def test_defaults_and_order():
    assert Stage().name == "Unnamed Pipe"
    assert list(Stage("s", [needs_example, succeeds]).transforms) == [needs_example, succeeds]
    stages = [Stage("a"), Stage("b")]
    assert [s.name for s in Pipeline(stages).stages] == ["a", "b"]


def test_success_leaves_no_error(spark):
    df = Stage("s", [needs_example]).apply(entities(spark, x=True))
    assert errors(df).isEmpty() and clean(df).count() == 1


def test_failing_row_gets_the_message_and_stays(spark):
    df = Stage("s", [needs_example]).apply(entities(spark, x=True, y=False))
    assert messages(df) == {"x": None, "y": "Component missing."}
    assert RESULT not in df.columns


def test_stage_message_replaces_one_set_by_the_transform(spark):
    def sets_own_error(df):
        own = F.struct(F.lit("set by the transform").alias("error_message"))
        return needs_example(set_component(df, "error", own, ~has_component("example")))

    assert messages(Stage("s", [sets_own_error]).apply(entities(spark, y=False))) == {"y": "Component missing."}


def test_later_failure_replaces_and_success_never_clears(spark):
    df = Stage("s", [needs_example, always_fails, succeeds]).apply(entities(spark, x=True, y=False))
    assert set(messages(df).values()) == {"System failed intentionally."}


def test_failure_without_a_message_is_still_a_failure(spark):
    df = Stage("s", [lambda d: d.withColumn(RESULT, fail(None))]).apply(entities(spark, x=True))
    assert errors(df).count() == 1 and messages(df) == {"x": None}


def test_writes_before_a_failure_stay(spark):
    def writes_then_fails(df):
        return always_fails(set_component(df, "written", F.struct(F.lit(1).alias("n"))))

    df = Stage("s", [writes_then_fails]).apply(entities(spark, x=True))
    assert df.select("written.n").first()[0] == 1


def test_each_transform_sees_all_rows_after_the_one_before(spark):
    seen = []

    def note(name):
        def transform(df):
            seen.append((name, "error" in df.columns))
            return df

        return transform

    Stage("s", [note("a"), note("b")]).apply(entities(spark, x=True))
    assert seen == [("a", True), ("b", True)]


def test_exceptions_are_not_caught(spark):
    broken = Stage("s", [lambda d: set_component(d, "n", F.struct(F.raise_error(F.lit("boom")).cast("int").alias("n")))])
    with pytest.raises(PySparkException, match="boom"):
        Pipeline([broken]).run(entities(spark, x=True)).collect()


def test_failing_stage_does_not_halt_the_chain(spark):
    mark = Stage("mark", [lambda d: set_component(d, "mark", F.struct(F.lit(1).alias("n")))])
    df = Pipeline([Stage("fails", [always_fails]), mark]).run(entities(spark, x=True))
    assert df.select("mark.n", "error.error_message").first() == (1, "System failed intentionally.")


def test_entity_without_components_vanishes_after_the_first_stage(spark):
    df = Pipeline([Stage("nothing"), Stage("fails", [always_fails])]).run(entities(spark, x=True, y=False))
    assert messages(df) == {"x": "System failed intentionally."}


def test_failing_in_the_first_stage_keeps_an_empty_entity(spark):
    df = Pipeline([Stage("fails", [needs_example]), Stage("later")]).run(entities(spark, y=False))
    assert messages(df) == {"y": "Component missing."}


def test_made_entities_show_from_the_next_stage_on(spark):
    def make(df):
        return df.select(F.concat("entity_id", F.lit("-child")).alias("entity_id"), "example")

    first = Stage("make", [lambda d: set_component(d, "one", F.struct(F.lit(1).alias("n")))], generators=[make])
    second = Stage("mark", [lambda d: set_component(d, "two", F.struct(F.lit(2).alias("n")))])
    df = Pipeline([first, second]).run(entities(spark, x=True))
    assert {tuple(r) for r in df.select("entity_id", "one.n", "two.n").collect()} == {("x", 1, 2), ("x-child", None, 2)}


def test_duplicate_input_collapses_after_the_first_stage(spark):
    given = entities(spark, x=True)
    seen = []

    def count(df):
        seen.append(df.count())
        return df

    df = Pipeline([Stage("a", [count]), Stage("b", [count])]).run(given.unionByName(given))
    assert seen == [2, 1] and df.count() == 1


def test_duplicate_input_makes_entities_twice(spark):
    def make(df):
        return df.select(F.concat("entity_id", F.monotonically_increasing_id().cast("string")).alias("entity_id"), "example")

    given = entities(spark, x=True)
    df = Pipeline([Stage("make", generators=[make])]).run(given.unionByName(given).coalesce(1))
    assert df.count() == 3


def test_stored_entities_outside_the_input_join_in(spark):
    storage = entities(spark, x=True, y=True)
    given = spark.createDataFrame([("x",), ("new",)], "entity_id string")
    mark = Stage("mark", [lambda d: set_component(d, "one", F.struct(F.lit(1).alias("n")))])
    df = Pipeline([mark, Stage("check", [needs_example])]).run(given, storage)
    assert {tuple(r) for r in df.select("entity_id", "one.n", "error.error_message").collect()} == {
        ("x", 1, None),
        ("y", None, None),
        ("new", 1, "Component missing."),
    }


def test_cut_writes_the_outcome_to_the_shared_folder(spark):
    df = Pipeline([Stage("keep it", [needs_example], cut=True)]).run(entities(spark, x=True, y=False))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert df.inputFiles() and all(shared in f for f in df.inputFiles())
    assert messages(df) == {"x": None, "y": "Component missing."}


def test_row_local_stages_need_no_shuffle(spark):
    stages = [Stage("a", [needs_example]), Stage("b", [always_fails])]
    df = Pipeline(stages).run(entities(spark, x=True), distinct_input=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_stages_gives_back_the_input(spark):
    assert Pipeline([]).run(entities(spark, x=True)).count() == 1


def test_transform_in_python_over_batches(spark):
    def shout(batches):
        for batch in batches:
            yield batch.assign(text=batch["text"].str.upper())

    def transform(df):
        return df.mapInPandas(shout, df.schema)

    given = spark.createDataFrame([("x", "a", (True,))], f"entity_id string, text string, example {EXAMPLE}")
    df = Pipeline([Stage("python", [transform]), Stage("check", [needs_example])]).run(given)
    assert [tuple(r) for r in df.select("text", "error").collect()] == [("A", None)]
