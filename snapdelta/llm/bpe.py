"""Byte-pair encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snapdelta.llm import wordtable
from snapdelta.llm.encode import encoder, split_marks
from snapdelta.llm.wordtable import squeeze, unsqueeze

_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def plain_words(text: str | None) -> list[bytes]:
    """A text cut where no token of the vocabulary can cross, in lower case where that gives the same ids."""
    return "\n".join(split_marks(text)).encode("utf-8", "surrogatepass").split(b"\n") if text else []


def encode_distinct(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of every distinct word, encoded once, joined back to the chunks that use it.

    An answer is the number of tokens of each word as 16 bits, then the ids one after the other.
    """

    def answer(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = encoder(tokenizer)
        known: dict[bytes, bytes] = {}
        for bucket, chunk, n, size, packed, _, positions in rows:
            asked = wordtable.unpack_words(packed, size)
            new = [w for w in asked if w not in known]
            known.update(zip(new, words.encode_words([w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
            ids = [known[w] for w in asked]
            lengths = wordtable.planes(np.array([len(x) // words.dtype.itemsize for x in ids], "<u4"))
            reply = lengths + wordtable.planes(np.frombuffer(b"".join(ids), words.dtype))
            yield chunk, bucket, n, positions, len(reply), squeeze(reply)

    return wordtable.by_word(chunks, answer)


def encoded(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", consume=None, schema: str = _OUT,
    **sizes: int,
) -> DataFrame:
    """Encode and decode every text; one row per document, duplicates of an id included.

    A null or empty text has no tokens and decodes to the empty text. ``consume(doc_id, positions, words)``
    makes the row of a document; by default the digests of its ids and of its decoded text. ``words`` has,
    by position, ``counts`` and the texts ``ids`` (decimal) and ``pieces``.
    """
    chunks = wordtable.split_words(docs, plain_words, id_col=id_col, text_col=text_col, **sizes)
    answers = encode_distinct(chunks, tokenizer)
    out = wordtable.arrow_schema(schema)
    consume = consume or digests

    def work(replies: Iterator[dict], blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        words = WordTexts(tokenizer, replies)
        for block in blocks:
            rows = [consume(doc, place, words) for doc, place in wordtable.documents(block)]
            yield wordtable.batch_of(rows, out)

    return wordtable.by_chunk(chunks, answers, work, schema)


class WordTexts:
    """What the words of a chunk become: number of tokens, ids in decimal, and pieces found by id."""

    pieces_by_id: dict[str, tuple[list[str], list[str]]] = {}

    def __init__(self, tokenizer: str, replies: Iterator[dict]):
        library = encoder(tokenizer)
        if tokenizer not in self.pieces_by_id:  # the vocabulary, whose size is fixed
            size = library.library.get_vocab_size(with_added_tokens=True)
            pieces = [library.library.id_to_token(i) or "" for i in range(size)]
            self.pieces_by_id[tokenizer] = (pieces, [str(i) for i in range(size)])
        pieces, decimal = self.pieces_by_id[tokenizer]
        rows = list(replies)
        n = sum(r["n"] for r in rows)
        self.counts = np.zeros(n, np.int64)
        self.ids, self.pieces = [""] * n, [""] * n
        for r in rows:
            at = wordtable.unpack_positions(r["positions"], r["n"])
            data = unsqueeze(r["data"], r["size"])
            lengths = wordtable.from_planes(data[: 4 * r["n"]], "<u4").astype(np.int64)
            ids = wordtable.from_planes(data[4 * r["n"] :], library.dtype).tolist()
            self.counts[at] = lengths
            start = 0
            for place, stop in zip(at.tolist(), np.cumsum(lengths).tolist(), strict=True):
                word = ids[start:stop]
                self.ids[place] = " ".join([decimal[i] for i in word])
                self.pieces[place] = " ".join([pieces[i] for i in word])
                start = stop


def digests(doc: int | None, place: np.ndarray, words: WordTexts) -> tuple:
    at = place.tolist()
    ids = " ".join(filter(None, map(words.ids.__getitem__, at)))
    decoded = " ".join(filter(None, map(words.pieces.__getitem__, at)))
    return (
        doc,
        int(words.counts[place].sum()),
        hashlib.sha256(ids.encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )
