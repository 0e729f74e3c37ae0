"""Physical plans: what is scanned, what is shuffled, what is broadcast."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import content_hash
from snapdelta.operators import components, delta, versions
from snapdelta.plans import table_flows
from snapdelta.sources import snapshots, state


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.range(1000).select("id", F.repeat(F.lit("text"), 10).alias("text"), F.lit("x").alias("other")).write.parquet(path)
    return spark.read.parquet(path)


def test_hashing_reads_two_columns_and_shuffles_nothing(docs):
    text = plan(docs.select("id", content_hash("text")))
    assert "ReadSchema: struct<id:bigint,text:string>" in text
    assert "Exchange" not in text and "Python" not in text


def test_lookup_shuffles_keys_and_hashes_but_no_content(spark, docs, no_broadcast):
    current = docs.select("id", content_hash("text").alias("current_hash"))
    state = current.withColumnRenamed("current_hash", "content_hash")
    shuffles = plan(delta.with_prior(current, state, ["id"]))
    below = shuffles.split("Exchange")[1]
    assert "sha2" in below.split("FileScan")[0]
    assert shuffles.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("buckets", [3, 8, 40])
def test_stored_state_is_not_shuffled(spark, docs, tmp_path, no_broadcast, monkeypatch, buckets):
    """Three tiers are joined with one exchange, that of the rows looked up."""
    key = [docs.schema["id"]]
    monkeypatch.setattr(state, "LIKE", 0)
    for n in (1000, 100, 10):
        hashes = docs.where(F.col("id") < n).select("id", F.lit(str(n)).alias("content_hash"))
        state.save_state(spark, str(tmp_path), hashes, key, buckets)
    tiers = state.open_state(spark, str(tmp_path), key)
    current = docs.select((F.col("id") * 2).alias("id"), content_hash("text").alias("current_hash"))
    joined = delta.with_prior(current, tiers, ["id"])
    text = plan(joined)
    assert len(tiers) == 3 and text.count("SortMergeJoin") == len(tiers) and text.count("Bucketed: true") == len(tiers)
    assert len(re.findall(r"\bExchange hashpartitioning", text)) == 1 and f", {buckets}), ENSURE" in text
    found = {r.id: r.previous_hash for r in joined.collect()}
    assert found == {k: "10" if k < 10 else "100" if k < 100 else "1000" if k < 1000 else None for k in range(0, 2000, 2)}


def test_first_run_hashes_each_row_once(spark, docs, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(table_flows, "write_version", lambda s, r, v, rows: seen.append(rows) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table_flows.backup_table(spark, docs, ["id"], ["text"], str(tmp_path))
    text = plan(seen[0])
    assert text.count("sha2(") == 1 and "Exchange" not in text and "PushedFilters: [IsNotNull(id), IsNotNull(text)]" in text


def test_latest_combines_before_the_shuffle(docs):
    text = plan(components.latest(docs, ["other"], ["id"], ["text"]))
    assert text.count("partial_max_by") == 1 and text.count("Exchange hashpartitioning") == 1
    before_shuffle = text.split("Exchange hashpartitioning")[1]
    assert "partial_max_by" in before_shuffle


def test_row_local_component_writes_stay_in_one_codegen_span(docs):
    df = components.set_component(docs, "mark", F.struct(F.lit(1).alias("n")), F.col("id") > 5)
    df = components.set_component(df, "mark", F.struct(F.lit(2).alias("n")), F.col("id") > 9)
    assert "Exchange" not in plan(df)


def test_reading_a_version_opens_that_version_only(spark, docs, tmp_path):
    for version in ("20240101000000", "20240102000000"):
        snapshots.write_version(spark, str(tmp_path), version, docs)
    read = snapshots.read_version(spark, str(tmp_path), "20240102000000", ["id"])
    assert read.inputFiles() and all("version=20240102000000" in f for f in read.inputFiles())
    assert "Exchange" not in plan(read)
    assert "ReadSchema: struct<id:bigint>" in plan(read.select("id"))


def test_position_of_versions_uses_no_window_and_no_shuffle_of_its_own(docs):
    """The dates are in order already: one distinct and one range partitioning came before."""
    lines = versions.version_lines(docs.select(F.timestamp_seconds("id").alias("backup_date")))
    text = plan(lines)
    assert "Window" not in text and "Exchange" not in text and "Sort" not in text


def test_restoring_into_a_target_shuffles_none_of_its_content(spark, docs, tmp_path, monkeypatch, no_broadcast):
    target = f"{tmp_path}/target"
    docs.repartition(10).write.parquet(target)
    written = []
    slice_of = table_flows._slice
    monkeypatch.setattr(table_flows, "_slice", lambda *args, **how: written.append(slice_of(*args, **how)) or written[-1])
    table_flows.restore_into(spark, target, docs.where("id < 3").withColumn("text", F.lit("new")), ["id"])
    text = plan(written[0])
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "BroadcastExchange" in exchanges[0]


def test_list_of_versions_is_joined_to_no_entity(docs):
    dates = docs.select(F.timestamp_seconds("id").alias("backup_date"))
    text = plan(versions.with_versions(docs.select("id"), dates))
    assert "Subquery" in text and "Join" not in text


def test_no_cross_joins(spark, docs):
    state = docs.select("id", content_hash("text").alias("content_hash"))
    merged = delta.merge_state(state, state, ["id"])
    lines = versions.version_lines(docs.select(F.timestamp_seconds("id").alias("backup_date")))
    for df in (merged, lines, components.upsert(state, state, ["id"])):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
