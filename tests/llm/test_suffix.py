"""Removal of repeated byte strings against a dictionary of all of them."""

from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest

from snapdelta.llm import queries, suffix


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            key = hashlib.blake2b(d[p : p + length], digest_size=16).digest()
            seen[key] = "many" if key in seen else (i, p)
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[hashlib.blake2b(d[p : p + length], digest_size=16).digest()] == "many":
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(doc), len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def mixed(seed, n=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(30, 260))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(150))) for _ in range(4)]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize(("length", "k"), [(200, 40), (60, 20), (61, 13)])
def test_random_mixtures(spark, make, length, k):
    rows = mixed(length)
    assert found(suffix.repeated_strings(make(rows), length, k)) == brute(rows, length)


def test_hot_anchors(spark, make, monkeypatch):
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(330))
    rows = [(i, f"{i * 7919} before {passage}{'' if i % 3 else i} after {i * 31}") for i in range(1300)]
    assert found(suffix.repeated_strings(make(rows))) == brute(rows, 200)


def test_awkward_rows(spark, make, awkward):
    rows = awkward + [(40, "ab" * 300), (41, "ab" * 300), (42, "q" * 199), (42, "q" * 199), (None, "z" * 250), (None, "z" * 250)]
    assert found(suffix.repeated_strings(make(rows))) == brute(rows, 200)
    assert suffix.repeated_strings(make([])).collect() == []


def test_long_texts_in_parts(monkeypatch):
    import numpy as np

    data = np.frombuffer(("".join(random.Random(3).choice("abc ") for _ in range(5000))).encode(), np.uint8)
    whole = suffix.anchors(data, 200, 40)
    monkeypatch.setattr(suffix, "_SPAN", 700)
    parts = suffix.anchors(data, 200, 40)
    starts = [{p: a for a, lo, hi in zip(x[0], x[2], x[3], strict=True) for p in range(lo, hi + 1)} for x in (whole, parts)]
    assert starts[0] == starts[1] and len(starts[0]) == 4801


def test_query(spark, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert found(queries.QUERIES["op10_suffix_array_dedup"](spark, sf_dir)) == brute([(r["doc_id"], r["text"]) for r in stored], 200)
