"""Token files and packing against the tokenizers library used plainly."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from snapdelta import scratch_dir
from snapdelta.llm import packing, queries, token_files
from snapdelta.llm.encode import WordEncoder


def plain_ids(tokenizer, text, end):
    return Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer, awkward, sf_dir):
    library, words = Tokenizer.from_file(tokenizer), WordEncoder(tokenizer, remember=50)
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in [t for _, t in awkward] + stored:
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == expected


def test_token_files_on_awkward_rows(spark, make, tokenizer, awkward):
    folder = scratch_dir(spark, "t")
    token_files.write_token_files(make(awkward), folder, tokenizer, 2)
    rows = token_files.token_digests(spark, folder).collect()
    expected = sorted((i is not None, i or 0, crc(plain_ids(tokenizer, t, 2)), len(plain_ids(tokenizer, t, 2))) for i, t in awkward)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in rows) == expected
    by_place = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in by_place] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in by_place] == [0, *np.cumsum([r.n_tokens for r in by_place])[:-1]]


def test_a_row_repeated_over_and_over_is_dealt_to_several_parts(spark, make, tokenizer):
    rows = [(5, "the same row again")] * 4000 + [(k, f"row {k}") for k in range(200)]
    folder = scratch_dir(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would be put together
    try:
        manifest = token_files.write_token_files(make(rows).repartition(8), folder, tokenizer, 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest) < 1500 and sum(r.n_docs for r in manifest) == len(rows)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_digests(spark, folder).collect())
    assert [d for _, d, _ in found] == sorted(i for i, _ in rows)
    assert [s for s, *_ in found] == [0, *np.cumsum([n for *_, n in found])[:-1]]


def test_token_files_of_an_empty_table(spark, make, tokenizer):
    folder = scratch_dir(spark, "t")
    assert token_files.write_token_files(make([]), folder, tokenizer, 2).count() == 0
    assert token_files.token_digests(spark, folder).collect() == []


def test_token_files_query(spark, sf_dir, tokenizer):
    stored = sorted(pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    start, expected = 0, []
    for r in stored:
        ids = plain_ids(tokenizer, r["text"], 2)
        expected.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    rows = queries.QUERIES["op3_token_files"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected


def check_packed(rows, capacity):
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(placed)


def test_packing_on_awkward_rows(spark, make, tokenizer, awkward):
    rows = packing.pack_documents(make(awkward), tokenizer, 1, 4096).collect()
    expected = []
    for i, t in awkward:
        ids = plain_ids(tokenizer, t, 1)
        cuts = range(0, len(ids), 4096)
        expected += [(str(i), k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(cuts)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    check_packed(rows, 4096)
    assert packing.pack_documents(make([]), tokenizer, 1).collect() == []


def test_packing_query_needs_few_sequences(spark, sf_dir):
    rows = queries.QUERIES["op9_best_fit_packing"](spark, sf_dir).collect()
    least = -(-sum(r.length for r in rows) // 4096)
    assert least <= check_packed(rows, 4096) <= least + 1


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_in_several_groups(spark, seed):
    lengths = np.random.default_rng(seed).geometric(0.02, 3000).clip(1, 300)
    cut = spark.createDataFrame([(int(x), int(x)) for x in lengths], "doc_id long, length long")
    rows = packing.pack(cut, 300, group_rows=500).collect()
    assert sorted(r.length for r in rows) == sorted(lengths.tolist())
    assert check_packed(rows, 300) <= -(-int(lengths.sum()) // 300) + 12
