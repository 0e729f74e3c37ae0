"""The queries over file trees on rows of their own."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from snapdelta.plans import queries

DOCUMENTS = [
    (1, "one", "en", "a"), (2, "two", "de", "b"), (3, "three", "es", "a"), (4, "four", "fr", "b"), (5, "five", "de", None),
]


def tables(spark, path, documents, items=((0, "gone"), (1, "lost"))):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def scratch(tmp_path, monkeypatch):
    """Where the queries put their file trees."""
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, purpose: str(tmp_path / "scratch" / purpose))
    return tmp_path / "scratch"


def test_restoring_over_needs_no_room_for_the_tree(spark, tmp_path, scratch, rows):
    found = queries.q_restore_files_over(spark, tables(spark, tmp_path / "in", DOCUMENTS))
    expected = {"a/1.txt": "one", "b/2.txt": "two", "a/3.txt": "three", "b/4.txt": "four", ".deleted/5.txt": "five", ".deleted/-1.txt": "gone", ".deleted/-2.txt": "lost"}
    assert rows(found) == sorted((n, sha(t)) for n, t in expected.items())
    assert set(os.listdir(scratch / "files")) - {"tree.staging"} == {"restored", "store", "versions"}


def test_the_latest_files_are_restored(spark, tmp_path, scratch, rows):
    found = queries.q_restore_latest_files(spark, tables(spark, tmp_path / "in", DOCUMENTS))
    expected = {"b/2.txt": "two", "a/3.txt": "three", "b/4.txt": "four", ".deleted/5.txt": "five"}
    assert rows(found) == sorted((n, sha(t)) for n, t in expected.items())


def joined(spark, path):
    docs = queries.table(spark, path, "documents").select("doc_id", "source")
    return queries.older_documents(spark, path).join(docs, ["doc_id"], "left").select("doc_id", "source", "text")


def test_sources_of_single_keys_need_no_shuffle_of_texts(spark, tmp_path, rows):
    path = tables(spark, tmp_path, DOCUMENTS)
    older = queries.older_sources(spark, path)
    plan = older._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert rows(older.select("doc_id", "source", "text")) == rows(joined(spark, path))


def test_keys_that_come_again_have_the_sources_of_all(spark, tmp_path, rows):
    odd = [
        (1, "twice", "en", "a"), (1, "twice", "en", "a"), (2, "other", "de", "b"), (2, "another", "es", "c"), (2, "third", "fr", None),
        (None, "no key", "en", "a"), (None, "no key", "de", "b"), (-1, "as deleted", "de", "a"), (7, "single", "fr", "b"),
    ]
    path = tables(spark, tmp_path, odd, [(0, "gone"), (1, "lost"), (1, "lost again"), (None, "none")])
    older = queries.older_sources(spark, path)
    assert rows(older.select("doc_id", "source", "text")) == rows(joined(spark, path))
    assert older.where(F.col("doc_id") == 2).count() == 6
