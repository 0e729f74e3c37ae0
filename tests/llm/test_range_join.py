"""Linked embeddings against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import queries, range_join
from tests.llm.test_minhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    units = []
    for _, v, label in rows:
        v = None if v is None or label is None or any(x is None for x in v) or not len(v) else np.array(v, np.float64)
        good = v is not None and np.isfinite(v).all() and v.any()
        units.append(v / np.linalg.norm(v) if good else None)
    links = [
        (i, j)
        for i in range(len(rows)) for j in range(i)
        if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
        and units[i] @ units[j] >= 0.93
    ]
    root, out = roots(len(rows), links), []
    for i, (vec, _, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        least = min((m for m in members if m is not None), default=None)
        kept = vec == least if vec is not None else len(members) == 1
        out.append((str(vec), sum(i in link for link in links), str(least), kept))
    return sorted(out)


def found(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def clusters(seed, n, dims=6, labels=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centers[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.01, 0.15, 0.5])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(labels))))
    return rows + [(n + i, rows[i % 3][1], rows[i % 3][2]) for i in range(20)]


def test_copies_that_differ_in_their_last_bit(spark):
    rng = np.random.default_rng(3)
    top = (rng.normal(size=16) * ([1] * 8 + [0.02] * 8)).astype(np.float32)
    rows = []
    for i in range(240):
        v = top.copy()
        if i % 2:  # a last bit of two small components
            for k in rng.integers(8, 16, size=2):
                v[k] = np.nextafter(v[k], np.float32(rng.choice([-9, 9])))
        else:  # at a cosine around the least
            v = v + (rng.normal(size=16) * np.linalg.norm(top) * rng.choice([0.08, 0.1, 0.12])).astype(np.float32)
        rows.append((i, v.tolist(), 1))
    assert found(range_join.linked_embeddings(spark.createDataFrame(rows, SCHEMA), pair_cost=1e6)) == brute(rows)


def test_many_cells_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(range_join, "BLOCK_BYTES", 6 * 8 * 16)
    monkeypatch.setattr(range_join, "PART", 30)
    monkeypatch.setattr(range_join, "SAMPLE", 100)
    rows = clusters(1, 500)
    tables = {}
    written = range_join.written
    monkeypatch.setattr(range_join, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    assert found(range_join.linked_embeddings(spark.createDataFrame(rows, SCHEMA), pair_cost=1e5)) == brute(rows)
    held = tables["held"].collect()
    assert len(held) > 10 and max(r.blocks for r in held) > 1 and tables["guests"].count() > 0


def compared(tables):
    """Pairs that meet, of all pairs within labels, and copies a vector."""
    away = tables["guests"].groupBy("label", "dims", "cell").agg(F.count(F.lit(1)).alias("guests"))
    held = tables["held"].join(away, ["label", "dims", "cell"], "left").fillna(0)
    met = held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("guests"))).first()[0]
    whole = tables["sizes"].agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return met / whole, 1 + tables["guests"].count() / tables["nodes"].count()


def test_clustered_vectors_are_compared_in_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 64))
    rows = [(i, (centers[i % 30] + rng.normal(size=64) * (0.05, 0.3, 0.6)[i % 3]).astype(np.float32).tolist(), i % 2) for i in range(3000)]
    tables = {}
    written = range_join.written
    monkeypatch.setattr(range_join, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    result = range_join.linked_embeddings(spark.createDataFrame(rows, SCHEMA))
    assert found(result) == brute(rows)
    share, copies = compared(tables)
    assert share < 0.5 and copies < 4


def test_pivots_of_every_label_on_the_given_tables(spark, sf_dir, monkeypatch):
    tables = {}
    written = range_join.written
    monkeypatch.setattr(range_join, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    range_join.linked_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sizes = {(r.label, r.dims): r.n for r in tables["sizes"].collect()}
    chosen = {(r.label, r.dims): len(r.pivots) // (8 * r.dims) for r in tables["pivots"].collect()}
    assert set(chosen) == set(sizes) and all(chosen[k] >= 2 for k, n in sizes.items() if n > 1)
    assert compared(tables)[0] <= 1 and len(tables["held"].collect()) > len(sizes)


def test_a_large_cluster_leaves_few_links(spark, monkeypatch):
    """Near copies over many blocks: one link between two blocks, not one for every vector and block."""
    monkeypatch.setattr(range_join, "BLOCK_BYTES", 8 * 8 * 20)
    rng = np.random.default_rng(7)
    top = rng.normal(size=8)
    rows = [(i, (top + rng.normal(size=8) * 0.01).astype(np.float32).tolist(), 1) for i in range(400)]
    tables = {}
    written = range_join.written
    monkeypatch.setattr(range_join, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    assert found(range_join.linked_embeddings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    blocks = sum(r.blocks for r in tables["held"].collect())
    assert blocks >= 20 and tables["across"].where("links IS NULL").count() <= blocks * (blocks - 1)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.05], 1), (None, [0.0, 1.0], 3), (12, [1e-30, 0.0], 1), (13, [1e30, 0.0], 1), (14, [1e-30, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS uid", "1 AS node", "2 AS unit")
    assert found(range_join.linked_embeddings(df)) == brute(rows)
    assert range_join.linked_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    stored = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    expected = brute([(r["vec_id"], r["embedding"], r["label"]) for r in stored])
    assert found(queries.QUERIES["op1_embedding_near_dedup"](spark, folder)) == expected
