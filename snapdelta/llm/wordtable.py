"""A corpus as numbered words: each distinct word travels once per chunk of documents instead of once per use.

``split_words`` cuts texts into words and writes, per chunk of documents, its distinct words and the
documents as positions in that list. ``by_word`` brings the words of all chunks together, dealt by word,
so that whatever is needed of a word is worked out once; ``by_chunk`` joins what was found back by
position. Rows are packed arrays, compressed: a row stands for thousands of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import spread, tasks, texts, written

#: Sizes of the packed rows: a chunk ends at so many words or distinct words, a block of documents at so many words.
CHUNK_WORDS, CHUNK_DISTINCT, BLOCK_WORDS = 4_000_000, 400_000, 262_144

#: ``kind`` 0: the words of a chunk, ``size`` bytes when unpacked, with a count each. 1: a block of documents.
_CHUNKS = "chunk long, kind int, size long, words binary, counts binary, doc_ids array<bigint>, lengths array<bigint>, positions binary"
_DEALT = "bucket int, chunk long, n int, size long, words binary, counts binary, positions binary"
_ANSWERS = "chunk long, bucket int, n int, positions binary, size long, answer binary"


class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def squeeze(data: bytes | np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(bytes(data), asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on, which compress far better than whole numbers."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, dtype: str | np.dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_places(place: np.ndarray) -> bytes:
    return squeeze(planes(place.astype("<u4")))


def unpack_places(data: bytes, size: int) -> np.ndarray:
    return from_planes(unsqueeze(data, size), "<u4")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema
    )


def arrow_schema(df_schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = []
    for name, kind in (x.split() for x in df_schema.split(",")):
        fields.append((name, pa.list_(pa.int64()) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


def split_words(
    docs: DataFrame, split: Callable[[str | None], list[bytes]], counted: Callable[[int | None], bool] | None = None,
    id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, chunk_distinct: int = CHUNK_DISTINCT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The written table of chunks. ``split`` gives the words of a text in UTF-8, without line ends in them.

    The counts are how often a word occurs in documents whose id ``counted`` accepts; without it there are none.
    A null text is what ``split`` makes of it. A document is never divided, so a very long one is a
    chunk of its own.
    """
    schema = arrow_schema(_CHUNKS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        numbers, ids, arrays, used = Numbers(), [], [], 0

        def rows() -> Iterator[tuple]:
            """The chunk's blocks and its words, the most frequent first, which gives the smallest numbers."""
            lengths = np.array([len(a) for a in arrays])
            place = np.concatenate([*arrays, np.zeros(0, np.uint32)])
            order = np.argsort(-np.bincount(place, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.uint32)
            rank[order] = np.arange(len(numbers))
            place = rank[place]
            counts = None
            if counted:
                use = np.repeat([counted(i) for i in ids], lengths).astype(bool)
                counts = squeeze(np.bincount(place[use], minlength=len(numbers)).astype("<u4").tobytes())
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or cuts[k + 1] - cuts[first] > block_words:
                    part = place[cuts[first] : cuts[k]]
                    yield chunk, 1, 4 * len(part), None, None, ids[first:k], lengths[first:k].tolist(), pack_places(part)
                    first = k
            if not numbers:
                return
            names = list(numbers)
            words = b"\n".join([names[i] for i in order.tolist()])
            yield chunk, 0, len(words), squeeze(words), counts, None, None, None

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = split(text.as_py())
                arrays.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                ids.append(doc)
                used += len(found)
                if used >= chunk_words or len(numbers) >= chunk_distinct or len(ids) >= chunk_words:
                    for row in rows():
                        yield batch_of([row], schema)
                    numbers, ids, arrays, used, chunk = Numbers(), [], [], 0, chunk + 1
        if ids:
            for row in rows():
                yield batch_of([row], schema)

    return written(texts(docs, id_col, text_col).mapInArrow(number, _CHUNKS), "chunks")


def unpack_words(words: bytes, size: int) -> list[bytes]:
    return unsqueeze(words, size).split(b"\n")


def pack_positions(positions: np.ndarray) -> bytes:
    """Ascending positions as differences."""
    return squeeze(planes(np.diff(positions.astype("<u4"), prepend=np.uint32(0)).astype("<u4")))


def unpack_positions(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(unsqueeze(data, 4 * n), "<u4"), dtype=np.int64)


def by_word(chunks: DataFrame, answer: Callable[[list[tuple]], Iterator[tuple]], schema: str = _ANSWERS) -> DataFrame:
    """Deal the distinct words of all chunks by word, and apply ``answer`` to each bucket of words.

    ``answer`` gets the bucket's rows as (bucket, chunk, n, size, words, counts, positions), read one
    after the other from an iterator, and yields rows of ``schema``. A word is in one bucket only, so each
    task holds the words of one bucket, whose number follows the shuffle setting.
    """
    buckets = tasks(chunks.sparkSession)
    dealt, out = arrow_schema(_DEALT), arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            words = unpack_words(row["words"], row["size"])
            counts = None if row["counts"] is None else np.frombuffer(unsqueeze(row["counts"], 4 * len(words)), "<u4")
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[k] : cuts[k + 1]]
                part = b"\n".join([words[i] for i in at.tolist()])
                rows.append((k, row["chunk"], len(at), len(part), squeeze(part), None if counts is None else squeeze(counts[at].tobytes()), pack_positions(at)))
            yield batch_of(rows, dealt)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: r[0]):
            waiting, size = [], 0
            for row in answer(group):
                waiting.append(row)
                size += sum(len(x) for x in row if isinstance(x, bytes)) + 64
                if size >= 1 << 22:
                    yield batch_of(waiting, out)
                    waiting, size = [], 0
            if waiting:
                yield batch_of(waiting, out)

    rows = chunks.where("kind = 0").select("chunk", "size", "words", "counts").mapInArrow(deal, _DEALT)
    return spread(rows, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(each, schema)


def by_chunk(
    chunks: DataFrame, answers: DataFrame, work: Callable[[Iterator[dict], Iterator[dict]], Iterator[pa.RecordBatch]], schema: str,
    with_words: bool = False,
) -> DataFrame:
    """Join the answers back by position: ``work(answer rows, block rows)`` for each chunk.

    Answers carry chunk, n, positions, size, answer; with ``with_words`` the chunk's own words come first
    as a row whose bucket is -1. One shuffle by chunk; a chunk is bounded and blocks are read one by one.
    """
    replies = answers.select(
        "chunk", F.lit(0).alias("kind"), "bucket", "n", "size", "positions", F.col("answer").alias("data"),
        F.lit(None).cast("array<bigint>").alias("doc_ids"), F.lit(None).cast("array<bigint>").alias("lengths"),
    )
    blocks = chunks.where("kind = 1" if not with_words else "true").select(
        "chunk", "kind", F.lit(-1).alias("bucket"), F.lit(0).alias("n"), "size",
        F.lit(None).cast("binary").alias("positions"), F.coalesce("positions", "words").alias("data"), "doc_ids", "lengths",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch)))
        for _, group in groupby(rows, key=lambda r: r["chunk"]):
            replies, first = [], None
            for row in group:
                if row["kind"] == 1:
                    first = row
                    break
                replies.append(row)

            def rest(first=first, group=group):
                if first is not None:
                    yield first
                    yield from group

            yield from work(iter(replies), rest())

    both = spread(replies.unionByName(blocks), "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return both.mapInArrow(run, schema)


def documents(block: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """Id and word positions of each document of a block row."""
    place = unpack_places(block["data"], block["size"])
    cuts = np.cumsum([0, *block["lengths"]])
    for k, doc in enumerate(block["doc_ids"]):
        yield doc, place[cuts[k] : cuts[k + 1]]
