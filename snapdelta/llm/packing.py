"""Documents into sequences of bounded length with as little unused room as possible: sum-of-squares packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import texts, written
from snapdelta.llm.encode import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids with ``end_id``, cut only where longer than ``capacity``. A null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            encoded = words.encode_all(text.as_py() for text in batch.column(1))
            for doc, packed in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.frombuffer(packed + end, words.dtype)
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = (doc, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(cut, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, by the sum-of-squares rule, longest first.

    ``open_at[g]`` counts open sequences with room g. A piece of length s moves one sequence from g to
    g - s; it goes where the sum of the squared counts becomes smallest, the roomiest first among equals.
    A sequence is opened only when no open one has room, which keeps the rule from opening what it cannot fill again.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    opened = 0
    for i in order:
        s = int(lengths[i])
        room = np.flatnonzero(open_at[s:]) + s
        if len(room):
            after = np.where(room > s, open_at[room - s], -0.5)  # a filled sequence is no longer counted
            g = int(room[len(room) - 1 - np.argmin((after - open_at[room])[::-1])])
            b = stacks[g].pop()
            open_at[g] -= 1
        else:
            g, b = capacity, opened
            opened += 1
        sequence[i], offset[i] = b, capacity - g
        if g > s:
            stacks.setdefault(g - s, []).append(b)
            open_at[g - s] += 1
    return sequence, offset


def pack(cut: DataFrame, capacity: int, group_rows: int = 16_384) -> DataFrame:
    """Place every row of ``cut`` (with a ``length`` of 1 to ``capacity``): adds sequence_id and offset.

    Rows are dealt at random into groups of about ``group_rows``, each packed by one task; their number
    grows with the rows. A group leaves a few sequences part-filled, out of thousands. Equal rows are
    told apart by a number given when the rows are written, so a key that fills a third of the table
    is dealt out as evenly as any other.
    """
    rows = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_rows))

    def place(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("uid", ignore_index=True)
        sequence, offset = sum_of_squares(df["length"].to_numpy(), capacity)
        return df.assign(sequence_id=df["pack_group"].to_numpy() * 2**32 + sequence, offset=offset)

    schema = rows.schema.add("pack_group", "long").add("sequence_id", "long").add("offset", "long")
    grouped = rows.withColumn("pack_group", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("pack_group")
    return grouped.applyInPandas(place, schema).drop("uid", "pack_group")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with ``end_id``, so an empty or null text is one piece of length 1. Repeated ids
    and equal texts are placed each for itself. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
