"""Token ids as flat binary files with 64-bit document offsets, in ascending order of documents.

A folder holds, per part, ``ids`` (unsigned integers, 2 bytes if the vocabulary allows, else 4),
``offsets`` (uint64, where each document starts within the part, with the end), ``keys`` (int64) and
``nulls`` (uint8, 1 where the key is null), and a manifest with the place of each part in the whole: the
bases are prefix sums over the parts. A part can be memory-mapped and a document is two offsets away.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import texts
from snapdelta.llm.encode import encoder

#: Words whose ids a worker remembers, twice over: nothing else in these tasks takes memory.
REMEMBER = 600_000

_PART = "part long, name string, width long, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, append ``end_id`` if given, and write parts in ascending order of ``id_col``.

    A null text is empty and a null id sorts first. Rows with the same id stay apart, ordered by a hash of
    their text and then by a number of their own, so a hot id, or a row that is repeated in a third of the table, falls into several
    parts. Very long texts are encoded whole. An empty table gives an empty manifest. Texts
    are shuffled once, by ranges of id. A repeated task writes files of new names, and only the names of the attempt
    that counted enter the manifest. Returns the manifest: part, name, width, n_docs, n_tokens and the bases.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "row")
    rows.mapInArrow(_writer(folder, tokenizer, end_id), _PART).write.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part; their number follows the shuffle setting, not the documents.
    manifest = spark.read.schema(_PART).parquet(f"{folder}/parts").select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _writer(folder: str, tokenizer: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, name = encoder(tokenizer, remember=REMEMBER), TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/data", recursive=True)
        end = b"" if end_id is None else np.array([end_id], words.dtype).tobytes()
        out, keys, nulls, sizes = None, [], [], [0]
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for packed in words.encode_all(text.as_py() for text in column):
                out = out or fs.open_output_stream(f"{base}/data/{name}.ids")
                packed += end
                out.write(packed)
                sizes.append(len(packed) // words.dtype.itemsize)
            nulls.append(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
            keys.append(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"))
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.array(sizes, "<u8"), dtype="<u8")
        for kind, content in (("offsets", offsets), ("keys", np.concatenate(keys)), ("nulls", np.concatenate(nulls))):
            with fs.open_output_stream(f"{base}/data/{name}.{kind}") as f:
                f.write(content.tobytes())
        row = [part, name, words.dtype.itemsize, len(sizes) - 1, int(offsets[-1])]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "name", "width", "n_docs", "n_tokens"), row, strict=True))])

    return write


def mapped(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """A file of a part, memory-mapped where the folder is on a mounted disk and else read by ``pyarrow.fs``."""
    fs, base = pa.fs.FileSystem.from_uri(folder)
    path = f"{base}/data/{name}.{kind}"
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, function, schema: str) -> DataFrame:
    """Apply ``function(doc_ids, starts, list of id arrays)`` to blocks of documents of every part.

    ``function`` returns a record batch of ``schema``. Parts are read by as many tasks as there are parts.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (row for batch in batches for row in batch.to_pylist()):
            ids = mapped(folder, part["name"], "ids", f"<u{part['width']}")
            offsets = mapped(folder, part["name"], "offsets", "<u8").astype(np.int64)
            keys = mapped(folder, part["name"], "keys", "<i8")
            nulls = mapped(folder, part["name"], "nulls", "u1").astype(bool)
            for k in range(0, len(keys), 4096):
                stop = min(k + 4096, len(keys))
                arrays = [ids[offsets[i] : offsets[i + 1]] for i in range(k, stop)]
                names = pa.array(keys[k:stop], pa.int64(), mask=nulls[k:stop])
                yield function(names, part["token_base"] + offsets[k:stop], arrays)

    return manifest.repartition(parts).mapInArrow(read, schema)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the checksum of its ids as 32-bit integers."""

    def digest(doc_ids, starts, arrays):
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array(starts, pa.int64()),
                pa.array([len(a) for a in arrays], pa.int64()),
                pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return read_token_files(spark, folder, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
