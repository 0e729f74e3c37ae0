"""Near duplicates against all pairs, and the shared way from links to components."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import minhash, queries
from snapdelta.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(rows):
    """The shingle set and the group of every row."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, roots(len(rows), links)


def brute(rows):
    sets, root = linked(rows)
    out = []
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        known = [m for m in members if m is not None]
        least = min(known, default=None)
        out.append((str(doc), len(sets[i]), str(least), doc == least if doc is not None else len(members) == 1))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7)]
    expected = roots(600, links)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    assert {r.node for r in rows} == {x for link in links if link[0] != link[1] for x in link}
    assert all(r.component == expected[r.node] for r in rows)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward_rows(spark, make, awkward):
    rows = awkward + [(20, "a b c"), (21, "A  B\tc"), (22, "a b"), (None, "alone " * 9), (None, "no key"), (3, "the same id with words of its own")]
    rows += [(30 + i, " ".join(f"w{j + i}" for j in range(40))) for i in range(12)]  # a chain of neighbours
    result = minhash.near_duplicates(make(rows))
    assert found(result) == brute(rows)
    assert minhash.near_duplicates(make([])).collect() == []


def test_one_keeper_for_each_group(spark, make):
    rows = [(1, "one two three four five six")] * 3 + [(None, "ONE two three four five six"), (2, None), (2, None), (3, "else")]
    result = minhash.near_duplicates(make(rows)).where("keeper").collect()
    assert sorted((r.doc_id, r.n_shingles) for r in result) == [(1, 2), (2, 0), (2, 0), (3, 1)]


def test_query(spark, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert found(queries.QUERIES["op7_minhash_near_dedup"](spark, sf_dir)) == brute([(r["doc_id"], r["text"]) for r in stored])


@pytest.mark.parametrize("nodes", [16, 1000])
def test_a_large_group_of_copies_that_are_hardly_alike(spark, make, monkeypatch, nodes):
    """Copies whose similarity to each other lies on both sides of the limit, in one cluster of many tiles."""
    monkeypatch.setattr(minhash, "TILE_NODES", nodes)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{rng.random()}" if rng.random() < 0.035 else w for w in base)) for i in range(150)]
    result = found(minhash.near_duplicates(make(rows)))
    assert result == brute(rows)
    assert 1 < sum(kept for *_, kept in result) < 149


def test_parities_never_differ_in_more_bits_than_the_sets_in_shingles(spark):
    rng = np.random.default_rng(3)
    rows, real = [], []
    for n in (1, 5, 63, 64, 65, 100, 250, 513, 9000):
        for shared in (0, n // 2, 6 * n // 7, n):
            for more in (0, n // 5):
                values = np.unique(rng.integers(0, 2**64, 3 * n + more, dtype=np.uint64))
                rng.shuffle(values)
                a, b = values[:n], values[n - shared : 2 * n - shared + more]
                rows.append([len(a), len(b), *(minhash.parities(x).view(np.int64).tolist() for x in (a, b))])
                real.append((len(a) + len(b) - 2 * shared, 100 * shared >= 75 * (len(a) + len(b) - shared)))
    df = spark.createDataFrame([[i, *r] for i, r in enumerate(rows)], "i int, na long, nb long, pa array<bigint>, pb array<bigint>")
    found = df.select("i", minhash._differing("pa", "pb").alias("bits"), minhash._alike(75).alias("alike")).collect()
    for r in found:
        differ, linked = real[r.i]
        assert r.bits <= differ and (r.alike or not linked)
        tile = minhash._Tile([(0, 0, 0, 0, j, j, rows[r.i][j], rows[r.i][2 + j], [0]) for j in (0, 1)])
        assert (1 in tile._alike(0, 75)) == r.alike == (0 in tile._alike(1, 75))
    assert not any(r.alike for r in found if rows[r.i][0] >= 63 and 2 * real[r.i][0] > sum(rows[r.i][:2]))


def test_rows_of_a_key_grow_with_its_largest_group_and_not_with_its_square(spark, monkeypatch):
    """Parts of a key's commonest component only meet the parts with other nodes, and every pair that can join components meets in a tile."""
    monkeypatch.setattr(minhash, "TILE_NODES", 10)
    rows = [(k, i, 0 if i < big else i, 5) for k, big, n in ((1, 400, 405), (2, 2, 30), (3, 1, 2)) for i in range(n)]
    tiles = minhash._tiles(spark.createDataFrame(rows, "key long, node long, component long, n long")).collect()
    met = {}
    for r in tiles:
        met.setdefault((r.key, r.p, r.q), {}).setdefault(r.part, []).append((r.node, r.component))
    pairs = [(k, *sorted((a, b))) for (k, p, q), by in met.items() for a, c in by.get(p, []) for b, d in by.get(q, []) if c != d and (p < q or a < b)]
    wanted = {(k, a, b) for k, a, c, _ in rows for j, b, d, _ in rows if k == j and a < b and c != d}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
    assert sum(r.key == 1 for r in tiles) <= 400 + 5 * 41


def test_only_asked_rows_are_shuffled(spark):
    rows = spark.range(-3000, 3000).select(F.col("id").alias("k"))
    asked = rows.where("k % 100 = 7")
    found = {r.k for r in minhash._among(rows, asked, "k").collect()}
    assert {k for k in range(-3000, 3000) if math.fmod(k, 100) == 7} <= found and len(found) < 100
    assert minhash._among(rows, asked.where("k > 5000"), "k").count() == 0


def test_rows_that_share_an_id_or_a_text(spark, make):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i % 3 if i % 2 else None, " ".join(f"y{rng.random()}" if rng.random() < 0.02 else w for w in base)) for i in range(24)]
    assert found(minhash.near_duplicates(make(rows + rows[:9]))) == brute(rows + rows[:9])
