"""Every stage of the pipeline against a brute-force version on its own input, and the pipeline as a whole."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from snapdelta.llm import quality
from tests.llm.test_minhash import linked
from tests.llm.test_suffix import brute as repeats
from tests.llm.test_suffix import mixed
from tests.llm.test_tokens import check_packed, crc, plain_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def documents(spark, rows):
    full = [(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).selectExpr("*", "'mine' AS document", "7 AS counts", "8 AS kept", "9 AS rows", "1 AS k1", "2 AS __text", "3 AS `a.b`")


def test_quality_stage(spark, awkward, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"] + 100, r["text"]) for r in stored] + awkward
    docs = documents(spark, rows)
    result = STAGES["quality_rules"](spark, docs, sf_dir)
    assert result.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in quality.judged(docs).collect() if r.kept)
    found = result.collect()
    assert sorted(str(r.doc_id) for r in found) == kept and 100 < len(kept) < len(rows)
    assert all((r.doc_id, r.text) in rows and r.document == "mine" for r in found)


def test_near_dedup_stage(spark, awkward, sf_dir):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"] + 100, r["text"]) for r in stored] + awkward + [(None, None), (50, "a b c d e f"), (50, "a b c d e f"), (51, "A b c d e f")]
    docs = documents(spark, rows)
    result = STAGES["minhash_near_dedup"](spark, docs, sf_dir)
    assert result.columns == docs.columns
    sets, group = linked(rows)
    least = {}
    for (doc, _), words, g in zip(rows, sets, group, strict=True):
        if words:
            least[g] = min(least.get(g, (True, 0)), (doc is None, doc or 0))
    empty = [(doc is None, doc or 0) for (doc, _), words in zip(rows, sets, strict=True) if not words]
    found = result.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted([*least.values(), *empty])


def test_repeat_stage(spark, awkward, sf_dir):
    rows = mixed(9) + [(i or 0, t) for i, t in awkward] + [(90, "é" * 150 + "x"), (91, "é" * 150 + "y"), (92, "q" * 300), (93, "q" * 300), (94, "q" * 150)]
    docs = documents(spark, rows)
    result = STAGES["suffix_array_dedup"](spark, docs, sf_dir)
    assert result.columns == docs.columns
    found = result.collect()
    assert len(found) == len(rows) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in found)
    sizes = sorted((d, n - gone) for d, n, gone, _, _ in repeats(rows, 200))
    assert sorted((str(r.doc_id), len((r.text or "").encode())) for r in found) == sizes
    assert sum(r.text is None for r in found) == 1


def test_packing_stage(spark, awkward, tokenizer):
    rows = STAGES["best_fit_packing"](spark, documents(spark, awkward), "").collect()
    expected = []
    for i, t in awkward:
        ids = plain_ids(tokenizer, t, 1)
        expected += [(str(i), s, crc(ids[s : s + 4096])) for s in range(0, len(ids), 4096)]
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in rows) == sorted(expected)
    check_packed(rows, 4096)


def test_whole(spark, sf_dir):
    rows = contract.queries()["pipeline"](spark, sf_dir).collect()
    ids = {r["doc_id"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id"]).to_pylist()}
    assert 100 < len({r.doc_id for r in rows}) < len(ids)
    check_packed(rows, 4096)


@pytest.mark.parametrize("name", STAGES)
def test_no_documents(spark, name, sf_dir):
    docs = documents(spark, [])
    result = STAGES[name](spark, docs, sf_dir)
    assert result.collect() == []
