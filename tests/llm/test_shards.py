"""Shards: equal counts, gapless slots, equal texts together."""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from snapdelta.llm import queries, shards


def check(rows, documents, number):
    expected = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in documents)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == expected
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts.values()) == sorted(len(rows) // number + (s < len(rows) % number) for s in range(number) if s < len(rows) or len(rows) >= number)
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def parted(rows):
    """Documents that are not in the fullest shard of their group, over the least possible number of them."""
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r.size), Counter())[r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_groups_stay_together(spark, make):
    documents = [(i, f"text {i // 7}") for i in range(1400)] + [(2000 + i, f"own {i}") for i in range(613)]
    rows = shards.assign(make(documents), 40).collect()
    check(rows, documents, 40)
    assert parted(rows) <= 30


def test_a_group_of_a_third_of_all_rows(spark, make):
    documents = [(i, "the same") for i in range(1000)] + [(1000 + i, f"pair {i // 2}") for i in range(1000)] + [(3000 + i, f"{i}") for i in range(1000)]
    rows = shards.assign(make(documents), 40).collect()
    check(rows, documents, 40)
    same = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the same"))
    assert sum(n for _, n in same.most_common(16)) >= 900
    pairs = {}
    for r in rows:
        if 1000 <= r.doc_id < 2000:
            pairs.setdefault(r.doc_id // 2, set()).add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 50


@pytest.mark.parametrize("number", [1, 3, 40])
def test_awkward_rows(spark, make, awkward, number):
    check(shards.assign(make(awkward), number).collect(), awkward, number)
    assert shards.assign(make([]), number).collect() == []


def test_many_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 16)
    documents = [(i, f"text {i // 3}") for i in range(500)]
    rows = shards.assign(make(documents), 7).collect()
    check(rows, documents, 7)
    assert parted(rows) <= 12


def test_query(spark, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    check(queries.QUERIES["op6_balanced_shards"](spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in stored], 40)


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    queries.QUERIES["op6_balanced_shards"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not any(w in plan for w in ("Python", "Pandas", "Arrow"))
