"""Repeated byte strings across and within documents by prefix doubling over sampled positions.

Any string of ``length`` bytes holds a position that its own bytes choose: the start of the k-gram with the
least hash among those in it. Equal strings choose the same one, so it is enough to rank these
anchors, about one byte in eighty, instead of every byte. Spark deals anchors by their hash and sorts them;
an anchor whose k-gram is nowhere else is unique and drops out. The others carry the bytes around them to the task of
their rank, where the positions that chose the anchor are ranked at growing lengths: a rank of twice the length comes
from the pair of ranks at a position and at the offset behind it, and what is unique drops out, up to ``length``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import document, spread, tasks, texts, written
from snapdelta.llm.shingles import mix

_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 20  # window starts handled at a time
#: Of anchors with more occurrences, windows are told apart by their common bytes before they meet in a task.
_HOT = 1000
_BLOCK = 16
#: Bytes around anchors that a task ranks together.
_TOGETHER = 1 << 20
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _SPAN + 4096
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def names(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of the ``size`` bytes at every position that has so many."""
    up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: n - size + 1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours, from running minima of blocks, forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their names, and for each the first and last start of a window that chose it."""
    width = length - k + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    for start in range(0, len(data) - length + 1, _SPAN):
        part = data[start : start + _SPAN + length - 1]
        named = mix(names(part, k))
        low = np.uint64(2**21 - 1)
        keys = (named & ~low) | np.arange(len(named), dtype=np.uint64)
        chosen = (_least(keys, width) & low).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        ends = np.append(cuts[1:], len(chosen)) - 1
        at = chosen[cuts]
        for column, values in zip(found, (at + start, named[at], cuts + start, ends + start), strict=True):
            column.append(values)
    if not found[0]:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    return tuple(np.concatenate(c) for c in found)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer() or b"", np.uint8)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, UTF-8 bytes and a key of 128 bits for the text, the same for equal texts."""
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _repeated_anchors(keyed: DataFrame, length: int, k: int) -> DataFrame:
    """``k1, k2, place, rank, hot``: the anchors of each text whose k-gram also starts elsewhere.

    A row of the shuffle holds the anchors of a batch of documents for one range of hashes.
    """
    buckets = tasks(keyed.sparkSession)
    dealt = "bucket int, k1 array<bigint>, k2 array<bigint>, sizes array<int>, places binary, hashes binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, len(b), 2048)):
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashes = [mix(anchors(data, length, k)[1]) for data in _bytes(batch.column(2))]
            doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
            h = np.concatenate([np.zeros(0, np.uint64), *hashes])
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                mine, sizes = np.unique(doc[at], return_counts=True)
                rows.append((b, k1[mine], k2[mine], sizes.astype(np.int32), place[at].astype("<u4").tobytes(), h[at].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                names=["bucket", "k1", "k2", "sizes", "places", "hashes"],
            )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for bucket, group in groupby(rows, key=lambda r: r["bucket"]):
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for r in group:
                sizes = np.array(r["sizes"], np.int64)
                parts[0].append(np.repeat(np.array(r["k1"], np.int64), sizes))
                parts[1].append(np.repeat(np.array(r["k2"], np.int64), sizes))
                parts[2].append(np.frombuffer(r["places"], "<u4"))
                parts[3].append(np.frombuffer(r["hashes"], "<u8"))
            k1, k2, place, h = (np.concatenate(p) for p in parts)
            order = np.argsort(h, kind="stable")
            k1, k2, place, h = k1[order], k2[order], place[order], h[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            # Equal texts give equal occurrences, which are one.
            own = mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64) + place.astype(np.uint64)))
            several = np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)
            sizes = np.diff(np.append(cuts, len(h)))
            keep = np.repeat(several, sizes)
            ranks = np.repeat(np.arange(len(cuts)) + (bucket << 40), sizes)[keep]
            kept = (k1[keep], k2[keep], place[keep].astype(np.int32), ranks, np.repeat(sizes > _HOT, sizes)[keep])
            names_ = ["k1", "k2", "place", "rank", "hot"]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=names_)
            for i in range(0, len(whole), 65_536):
                yield whole.slice(i, 65_536)

    rows = keyed.select("k1", "k2", "text").mapInArrow(deal, dealt)
    # A bucket is a range of hashes: the ranks are the places in the sorted order of all anchors.
    return spread(rows, "bucket").sortWithinPartitions("bucket").mapInArrow(
        rank, "k1 long, k2 long, place int, rank long, hot boolean"
    )


def _windows(marked: DataFrame, length: int, k: int) -> DataFrame:
    """Rows ``key, context, first, refs``: the bytes of the windows that chose a repeated anchor.

    ``first`` is how far before the anchor the first window starts. Equal rows of a batch are one, with
    several references. The windows of a hot anchor go by blocks of starts and by the bytes that all windows of a block share.
    """
    out = "key long, context binary, first int, k1 array<bigint>, k2 array<bigint>, at array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            rows: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}
            marks = batch.column(3).to_pylist()
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (k1, k2), data, marked_here in zip(keys, _bytes(batch.column(2)), marks, strict=True):
                positions, _, first, last = anchors(data, length, k)
                for mark in marked_here:
                    a, lo, hi = (int(x[mark["place"]]) for x in (positions, first, last))
                    if not mark["hot"]:
                        row = (mark["rank"], a - lo, data[lo : hi + length].tobytes())
                        rows.setdefault(row, []).append((k1, k2, a))
                        continue
                    for j in range((a - hi) // _BLOCK, (a - lo) // _BLOCK + 1):
                        s, e = max(lo, a - _BLOCK * j - _BLOCK + 1), min(hi, a - _BLOCK * j)
                        shared = data[a - _BLOCK * j : a - _BLOCK * j - _BLOCK + 1 + length].tobytes()
                        core = hashlib.blake2b(shared, digest_size=8, salt=str(j).encode(), person=str(mark["rank"]).encode()[-16:])
                        row = (int.from_bytes(core.digest(), "little", signed=True), a - s, data[s : e + length].tobytes())
                        rows.setdefault(row, []).append((k1, k2, a))
            columns = [[], [], [], [], [], []]
            for (key, start, context), refs in rows.items():
                for column, value in zip(columns, (key, context, start, *zip(*set(refs), strict=True)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["key", "context", "first", "k1", "k2", "at"],
            )

    return marked.select("k1", "k2", "text", "marks").mapInArrow(cut, out)


def _long_names(data: np.ndarray, size: int) -> np.ndarray:
    """``names`` of data of any length."""
    if len(data) <= _SPAN:
        return names(data, size)
    return np.concatenate([names(data[i : i + _SPAN + size - 1], size) for i in range(0, len(data) - size + 1, _SPAN)])


def repeated_windows(contexts: list[bytes], weights: list[int], groups: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its window starts hold a string that another occurrence in its group has too.

    Lengths grow from a quarter of ``length``; a pair of names, at a start and at the offset behind it, is the
    name of the longer string, and starts whose name is unique drop out. Many groups are ranked together.
    """
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    weight = np.array(weights)[owner]
    size = max(1, length // 4)
    # Names that run over the end of a context are never looked up.
    named = _long_names(np.frombuffer(b"".join(contexts), np.uint8), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + within
    alive = np.arange(len(owner))
    key = named[at] + mix(np.array(groups, np.int64).view(np.uint64))[owner]
    offsets = list(range(size, length - size, size)) + [length - size]
    steps = [offsets[:1], offsets[1:]]  # twice the length, then the whole
    alive, key = _several(alive, key, weight)
    for step in steps:
        for offset in step:
            key = mix(key) + named[at[alive] + offset]
        alive, key = _several(alive, key, weight)
    found = np.zeros(len(owner), bool)
    found[alive] = True
    return np.split(found, np.cumsum(counts)[:-1])


def _several(alive: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(alive):
        return alive, key
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    total = np.add.reduceat(weight[alive[order]], cuts)
    keep = np.sort(order[np.repeat(total > 1, np.diff(np.append(cuts, len(key))))])
    return alive[keep], key[keep]


def _pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _covered(rows: list[tuple[int, int, bytes, set]], length: int) -> Iterator[pa.RecordBatch]:
    """The runs of bytes that repeated windows cover, for rows of whole groups: key, first, context, references."""
    if not rows:
        return
    found = repeated_windows([r[2] for r in rows], [len(r[3]) for r in rows], [r[0] for r in rows], length)
    out: list[tuple[int, int, int, int]] = []
    for (_, first, _, refs), hits in zip(rows, found, strict=True):
        if hits.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hits, [0]]))).tolist()
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                out += [(k1, k2, a - first + s, a - first + e - 1 + length) for k1, k2, a in refs]
    if out:
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "start", "stop"])


def _spans(windows: DataFrame, length: int) -> DataFrame:
    """``k1, k2, start, stop``: the runs of bytes that repeated windows cover."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True) for b in batches for batch in _pieces(b, 1024))
        rows = (r for c in columns for r in c)
        waiting: list[tuple[int, int, bytes, set]] = []
        size = 0
        for key, group in groupby(rows, key=lambda r: r[0]):
            merged: dict[tuple[int, bytes], set] = {}
            for _, context, first, k1, k2, at in group:
                merged.setdefault((first, context), set()).update(zip(k1, k2, at, strict=True))
            if sum(map(len, merged.values())) > 1:
                waiting += [(key, first, context, refs) for (first, context), refs in merged.items()]
                size += sum(len(context) for _, context in merged)
            if size >= _TOGETHER:
                yield from _covered(waiting, length)
                waiting, size = [], 0
        yield from _covered(waiting, length)

    dealt = spread(windows, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "k1 long, k2 long, start long, stop long")


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """``k1, k2, n_removed, n_spans, kept_sha256`` and the kept text, from text and spans."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, spans in zip(_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in spans):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2], strict=True))
                row = (len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeated_strings(
    docs: DataFrame, length: int = 200, k: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte that a string of ``length`` bytes covers which also starts elsewhere in the input. A null text is
    empty, and a text shorter than ``length`` stays whole. Documents with equal texts of ``length`` bytes or more
    are removed whole; equal rows count as several. ``k`` is the size of the k-grams that choose anchors.
    """
    keyed = _keyed(docs, id_col, text_col)
    sha = F.sha2("text", 256)
    narrow, once, cleaned = _found(keyed, sha, length, k, with_text=False)
    rows = narrow.join(once.select("k1", "k2", "copies"), ["k1", "k2"]).join(cleaned, ["k1", "k2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)

    def choose(all_gone: Column, otherwise: Column) -> Column:
        return F.when(whole, all_gone).otherwise(otherwise)

    return rows.select(
        "doc_id", "n_bytes",
        choose(F.col("n_bytes"), F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        choose(F.lit(1), F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        choose(F.sha2(F.lit(b""), 256), F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, length: int = 200, k: int = 40, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars"
) -> DataFrame:
    """The documents with ``repeated_strings`` taken out of their texts and ``n_chars`` counted anew where there is such a column.

    Every row stays, if need be with an empty text; a null text stays null. A character of which only a part is
    removed goes whole, so that the text is valid.
    """
    keyed = _keyed(docs, id_col, text_col)
    _, once, cleaned = _found(keyed, F.lit(None).cast("string"), length, k, with_text=True)
    content = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(
        document(docs), docs[text_col].alias("text"), F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(1), content).alias("k2")
    )
    changed = once.where("copies > 1").select("k1", "k2", F.lit("").alias("kept"), F.lit(length).alias("from"))
    changed = written(changed.unionByName(cleaned.select("k1", "k2", "kept", F.lit(0).alias("from"))), "changed")
    joined = rows.join(changed, ["k1", "k2"], "left")
    text = F.when(F.octet_length("text") >= F.col("from"), F.col("kept")).otherwise(F.col("text"))
    changed = {text_col: text}
    if chars_col in docs.columns:
        changed[chars_col] = F.length(text).cast(docs.schema[chars_col].dataType)
    return joined.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def _found(keyed: DataFrame, sha: Column, length: int, k: int, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents by key, the texts with their number of copies, and of the texts that keep a part what they keep."""
    narrow = keyed.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"))
    narrow = written(narrow, "texts")
    once = narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one"))
    marks = written(_repeated_anchors(keyed, length, k), "anchors")
    marks = marks.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "rank", "hot")).alias("marks"))
    # One row of each text brings its bytes.
    asked = marks.join(once, ["k1", "k2"])
    chosen = keyed.join(asked, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("one")))
    chosen = written(chosen.select("k1", "k2", "text", "marks", "copies"), "chosen")
    spans = _spans(_windows(chosen, length, k), length)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    partly = chosen.where("copies = 1").select("k1", "k2", "text").join(spans, ["k1", "k2"])
    cleaned = _kept(partly, with_text)
    return narrow, once, cleaned
