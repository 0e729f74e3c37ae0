"""Encoding and decoding through the word table against the library used plainly."""

from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from snapdelta.llm import bpe, queries


def plain(tokenizer, rows):
    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((str(doc), len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def test_awkward_rows(spark, make, tokenizer, awkward):
    assert found(bpe.encoded(make(awkward), tokenizer)) == plain(tokenizer, awkward)
    assert bpe.encoded(make([]), tokenizer).collect() == []


def test_small_chunks_and_blocks(spark, make, tokenizer, awkward):
    df = bpe.encoded(make(awkward), tokenizer, chunk_distinct=5, block_words=3)
    assert found(df) == plain(tokenizer, awkward)


def test_query(spark, sf_dir, tokenizer):
    stored = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = plain(tokenizer, [(r["doc_id"], r["text"]) for r in stored])
    assert found(queries.QUERIES["op5_bpe_round_trip"](spark, sf_dir)) == expected
