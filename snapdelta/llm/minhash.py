"""Near-duplicate documents by minhash with tensored banding, verified on full shingle sets.

Two small collections of hashes are made of each document, and a table's key combines one of the first with one
of the second: from 2 x m hashes come m x m tables. Two documents of similarity s share a key with
probability (1 - (1 - s^2)^m)^2, which is 0.9995 at s = 0.75 and m = 10.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import components, document, matched, spread, texts, written
from snapdelta.llm.shingles import minhashes, mix, shingle_set

#: Hashes in each collection, and minhashes in a hash.
M, WIDTH = 10, 2
_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 2**63, 2 * M * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(1, 2**63, 2 * M * WIDTH, dtype=np.uint64)
#: Words of 64 bits in the parities of a set, at most.
_MOST_WORDS = 128
#: Bits that tell which texts may be asked for; its size does not grow with the table.
_FILTER_BITS = 1 << 23
#: Nodes and shingles in a part of a key, two of which are compared in one task.
TILE_NODES, TILE_SHINGLES = 1024, 600_000
#: Rows that a center is compared with in one task.
_PER_TASK = 256

_SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, hashes array<bigint>, parity array<bigint>"


def _signed(value: np.ndarray) -> np.ndarray:
    return value.view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of a power of two of bits, at least as many as shingles (up to a limit), whether an odd number of shingles falls on it.

    Where the parities of two sets differ, at least one shingle is in one set only, so sets differ in at least as many shingles as bits.
    The halves of a set's parities, combined by xor, are its parities in half as many bits.
    """
    words = min(_MOST_WORDS, 1 << max(0, (len(shingles) - 1).bit_length() - 6))
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of shingles, 128 bits that stand for its set, the two collections of hashes and its parities."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, hashes, parity = [], [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), size)
                n.append(len(found))
                sums = np.array([found.sum(dtype=np.uint64), mix(found + np.uint64(1)).sum(dtype=np.uint64)])
                a.append(int(_signed(sums)[0]))
                b.append(int(_signed(sums)[1]))
                if not len(found):
                    hashes.append(None)
                    parity.append(None)
                    continue
                parts = mix(minhashes(found, _FACTORS, _TERMS)).reshape(2 * M, WIDTH)
                hashes.append(_signed(mix(parts[:, 0] * np.uint64(31) + parts[:, 1])))
                parity.append(_signed(parities(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "hashes", "parity"],
            )

    return texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, _SIGNED)


def tables(nodes: DataFrame) -> DataFrame:
    """Rows of all tables: ``key, node``. A hash that no other node has cannot be part of a shared key."""
    halves = nodes.select("node", F.posexplode("hashes").alias("place", "hash"))
    common = halves.groupBy("place", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = halves.join(common, ["place", "hash"]).groupBy("node").agg(F.collect_list(F.struct("place", "hash")).alias("h"))
    first = F.explode(F.filter("h", lambda x: x.place < M)).alias("a")
    pairs = shared.select("node", "h", first).select(
        "node", "a", F.explode(F.filter("h", lambda x: x.place >= M)).alias("b")
    )
    return pairs.select(F.xxhash64("a.place", "a.hash", "b.place", "b.hash").alias("key"), "node")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b``, those with 100 * intersection >= percent * union of the full sets.

    The sets of up to a few hundred ``a`` are sent to each copy of ``b``'s, so no ``b``, however frequent, is one task's work.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _PER_TASK).cast("long").alias("blocks"))
    dealt = pairs.join(blocks, "b").withColumn("block", F.pmod(F.xxhash64("a"), "blocks"))
    others = dealt.join(sets.withColumnRenamed("node", "a"), "a").select("b", "block", F.col("a").alias("node"), "shingles")
    centers = blocks.select(F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    centers = centers.join(sets, "node").select(F.col("node").alias("b"), "block", F.lit(None).cast("long").alias("node"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k) for k in range(4)), strict=True))
        rows = ((b.as_py(), block.as_py(), node.as_py(), s.as_py()) for b, block, node, s in rows)
        for (b, _), group in groupby(rows, key=lambda r: r[:2]):
            _, _, _, packed = next(group)
            center = np.frombuffer(packed, np.uint64)
            linked = []
            for _, _, node, packed in group:
                if node is None:
                    continue
                other = np.frombuffer(packed, np.uint64)
                at = np.minimum(np.searchsorted(center, other), len(center) - 1)
                common = int((center[at] == other).sum())
                if 100 * common >= percent * (len(center) + len(other) - common):
                    linked.append(node)
            yield pa.RecordBatch.from_pydict({"a": pa.array(linked, pa.int64()), "b": pa.array([b] * len(linked), pa.int64())})

    both = spread(others.unionByName(centers), "b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("node"))
    return both.mapInArrow(compare, "a long, b long")


def _differing(a: str, b: str) -> Column:
    """Bits in which the parities differ, the longer ones folded; null if these are more than twice as long."""

    def fold(x: str) -> str:
        return f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"

    def bits(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"

    return F.expr(f"CASE WHEN size({a}) = size({b}) THEN {bits(a, b)} WHEN size({a}) > size({b}) THEN {bits(fold(a), b)} ELSE {bits(a, fold(b))} END")


def _alike(percent: int) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles with parities ``pa`` and ``pb`` can be linked: not if they are too unlike in size, or differ in more than
    (100 - percent) / (100 + percent) of their shingles. Both hold for every linked pair."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & F.coalesce((100 + percent) * _differing("pa", "pb") <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))


def near_duplicates(
    docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_a, set_b, component_id, kept, keeper.

    Documents with equal sets are one node. The nodes of a key are first compared with its smallest node. In keys that
    then still hold nodes without a link between them, all that can be alike by the parities of their sets are compared in tiles, so no link
    between different texts is lost to the grouping, nothing is concluded from a key alone, and a large group is never expanded into its
    pairs. A document without words is linked with nothing. Very long texts are taken whole.
    ``component_id`` is the smallest doc_id reachable, ``kept`` whether it is the document's own; a null id
    counts as largest and is kept only if it is alone. ``keeper`` marks exactly one row of each group, also
    among rows that share an id. An empty table gives no rows.
    """
    signed = written(signatures(docs, size, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    full = signed.where("n_shingles > 0")
    nodes = full.groupBy("set_a", "set_b").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.first("hashes").alias("hashes"), F.first("parity").alias("parity"),
        F.first("n_shingles").alias("n"), F.min_by(F.xxhash64("doc_id", "text_hash"), "uid").alias("text_key"),
    )
    nodes = written(nodes, "nodes")
    rows = written(tables(nodes), "tables")
    shared = rows.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = written(rows.join(shared, "key"), "shared")
    stars = rows.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    tested = written(_likely(stars, nodes, percent), "pairs")
    ends = tested.select(F.explode(F.array("a", "b")).alias("node"))
    links = written(verified(tested, _sets(docs, nodes, ends, size, id_col, text_col), percent), "links")
    # Keys whose nodes are not all linked yet: compared within each key.
    keys = _worth_comparing(_open_keys(rows, links), nodes, percent)
    sets = _sets(docs, nodes, keys.select("node"), size, id_col, text_col)
    links = links.unionByName(written(_compared(keys, nodes, sets, percent), "links"))

    found = components(links)
    labels = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = written(labels.select("set_a", "set_b", "component", "least_id"), "labels")
    named = labels.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    labels = matched(labels, written(named, "named"), ["component"], "nodes")
    labels = labels.select("set_a", "set_b", "component", "component_id")
    rows = signed.select("doc_id", "text_hash", "uid", "n_shingles", "set_a", "set_b")
    joined = written(rows.where("n_shingles > 0").join(labels, ["set_a", "set_b"]), "joined")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    first = joined.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members"))
    joined = matched(joined, written(first, "first"), ["component"], "members").withColumn("keeper", F.col("uid") == F.col("first.uid"))
    alone = F.col("members") == 1
    joined = joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), alone))
    empty = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True), "keeper": F.lit(True)})
    columns = ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "component_id", "kept", "keeper"]
    return joined.select(columns).unionByName(empty.select(columns))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near duplicates: one row of each group stays, with all its columns.

    Documents without words all stay. Texts are shuffled once, by id and hash; of equal rows the first is found by an
    aggregate, so that a row that fills a third of the table is reduced in each task.
    """
    found = near_duplicates(docs, percent, size, id_col, text_col)
    found = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.count_if("keeper").alias("keepers"))
    found = written(found.where("keepers > 0").withColumn("known", F.col("doc_id").isNotNull()).na.fill(0, ["doc_id"]), "keepers")
    key = docs[id_col].cast("long")
    rows = docs.select(
        document(docs), F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNotNull().alias("known"),
        F.xxhash64(docs[text_col]).alias("text_hash"),
    )
    joined = rows.join(found, ["doc_id", "known", "text_hash"])
    all_stay = joined.where("rows = keepers").select("document.*")
    first = joined.where("rows > keepers").groupBy("doc_id", "known", "text_hash").agg(F.first("document").alias("document"))
    return all_stay.unionByName(first.select("document.*"))


def _open_keys(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``key, node, component`` of the keys whose nodes are not all in one component."""
    labelled = rows.select("key", "node").distinct().join(components(links), "node", "left")
    labelled = written(labelled.withColumn("component", F.coalesce("component", "node")), "labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
    return written(labelled.join(several.select("key"), "key", "left_semi"), "open")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b``, those that can be linked by size and parities."""
    left = nodes.select(F.col("node").alias("a"), F.col("parity").alias("pa"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("parity").alias("pb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").where(_alike(percent)).select("a", "b")


def _tiles(keys: DataFrame, shingles: int | None = None) -> DataFrame:
    """``key, p, q, part, node, component``: the nodes of each pair of parts of a key between which a link can join components.

    ``keys`` has ``key, node, component, n``. A key's commonest component has parts of its own, which only meet the parts with all the other
    nodes: of a group that is linked but for a few nodes, the rows grow with its size, not with its square.
    """
    counts = keys.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))

    def parts(rows: str, n: str) -> Column:
        count = F.ceil(F.col(rows) / TILE_NODES)
        return (F.greatest(count, F.ceil(F.col(n) / shingles)) if shingles else count).cast("int")

    sums = counts.groupBy("key").agg(
        F.max(F.struct("rows", "component", "n")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    sums = sums.select("key", F.col("main.component").alias("main"), "main.rows", "main.n", (F.col("rows") - F.col("main.rows")).alias("others"), (F.col("n") - F.col("main.n")).alias("m"))
    sums = sums.select("key", "main", parts("rows", "n").alias("first"), parts("others", "m").alias("more"))
    dealt = keys.join(sums, "key").withColumn("of_main", F.col("component") == F.col("main"))
    at = F.xxhash64("node")
    part = F.when(F.col("of_main"), F.pmod(at, "first")).otherwise(F.col("first") + F.pmod(at, "more")).cast("int")
    others = F.sequence(F.when(F.col("of_main"), F.col("first")).otherwise(0), F.col("first") + F.col("more") - 1)
    tiles = dealt.withColumn("part", part).withColumn("other", F.explode(others))
    return tiles.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "component")


def _light(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, parity`` and all ``keys`` of the nodes in ``keys``."""
    return nodes.select("node", "n", "parity").join(keys.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")), "node")


def _worth_comparing(keys: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the rows ``key, node, component`` those whose node has a partner in its key that can be linked with it, by sizes and parities; with ``n``.

    A pair that shares several keys counts in the smallest of them. So a key's full sets are only fetched where they are needed.
    """
    full = _tiles(keys.withColumn("n", F.lit(0))).join(_light(keys, nodes), "node")
    full = full.select("key", "p", "q", "part", "node", "component", "n", "parity", "keys")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (key, _, _), group in groupby(rows, key=lambda r: r[:3]):
            tile = _Tile(list(group))
            chosen = np.flatnonzero(tile.worth(key, percent)).tolist()
            columns = [key] * len(chosen), [tile.nodes[i] for i in chosen], [tile.components[i] for i in chosen], tile.sizes[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "node", "component", "n"])

    dealt = spread(full, "key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return written(dealt.mapInArrow(choose, "key long, node long, component long, n long").distinct(), "worth")


def _compared(keys: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is linked within each key, found by comparing the full sets of its nodes that can be alike.

    A key is dealt into parts of bounded size, and pairs of parts are tiles, each for one task: no pairs leave a task but those that
    connect. A pair that shares several keys is compared in the smallest of them.
    """
    full = _tiles(keys, TILE_SHINGLES).join(_light(keys, nodes).join(sets, "node"), "node")
    full = full.select("key", "p", "q", "part", "node", "component", "n", "parity", "keys", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k) for k in range(10)), strict=True))
        rows = (tuple(x.as_py() for x in r) for r in rows)
        for (key, _, _), group in groupby(rows, key=lambda r: r[:3]):
            pairs = _Tile(list(group)).links(key, percent)
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread(full, "key", "p", "q").sortWithinPartitions("key", "p", "q", "node").mapInArrow(compare, "a long, b long")


class _Tile:
    """The nodes of two parts of a key (or of one with itself): of each its component, size, parities, keys and maybe its set."""

    def __init__(self, rows: list[tuple]):
        p, q = rows[0][1:3]
        self.here = [i for i, r in enumerate(rows) if r[3] == p]
        self.there = np.array([i for i, r in enumerate(rows) if r[3] == q], np.int64)
        self.nodes, self.components = [r[4] for r in rows], [r[5] for r in rows]
        _, self.group = np.unique(self.components, return_inverse=True)
        self.sizes = np.array([r[6] for r in rows])
        self.words = np.array([len(r[7]) for r in rows])
        # The parities of each and those folded once, filled up to the same length.
        self.parity = np.zeros((2, len(rows), self.words.max()), np.uint64)
        for i, r in enumerate(rows):
            whole = np.array(r[7], np.int64).view(np.uint64)
            self.parity[0, i, : len(whole)] = whole
            half = len(whole) // 2
            self.parity[1, i, :half] = whole[:half] ^ whole[half:]
        self.keys = [r[8] for r in rows]
        self.sets = [np.frombuffer(r[9], np.uint64) for r in rows if len(r) > 9]

    def worth(self, key: int, percent: int) -> np.ndarray:
        """Which nodes have a partner that may be linked with them."""
        found = np.zeros(len(self.nodes), bool)
        for i in self.here:
            for j in self._alike(i, percent):
                if not (found[i] and found[j]) and _least_common(self.keys[i], self.keys[j]) == key:
                    found[i] = found[j] = True
        return found

    def links(self, key: int, percent: int) -> list[tuple[int, int]]:
        """Links between the parts, as many as connect what all links connect."""
        edges = []
        for i in self.here:
            for j in self._alike(i, percent):
                # Earlier links may have joined the two meanwhile.
                if self.group[i] != self.group[j] and _least_common(self.keys[i], self.keys[j]) == key and self._linked(i, j, percent):
                    edges.append((self.nodes[i], self.nodes[j]))
                    self.group[self.group == self.group[j]] = self.group[i]
        return edges

    def _alike(self, i: int, percent: int) -> np.ndarray:
        """Nodes of other components that can be linked by size and parities: no linked pair differs in more of either."""
        there = self.there[self.group[self.there] != self.group[i]]
        sizes = self.sizes[there]
        there = there[100 * np.minimum(sizes, self.sizes[i]) >= percent * np.maximum(sizes, self.sizes[i])]
        mine, yours = (self.words[there] < self.words[i]).astype(int), (self.words[there] > self.words[i]).astype(int)
        differ = np.bitwise_count(self.parity[mine, i] ^ self.parity[yours, there]).sum(axis=1, dtype=np.int64)
        far = np.maximum(self.words[there], self.words[i]) > 2 * np.minimum(self.words[there], self.words[i])
        return there[far | ((100 + percent) * differ <= (100 - percent) * (self.sizes[there] + self.sizes[i]))]

    def _linked(self, i: int, j: int, percent: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 100 * common >= percent * (len(a) + len(b) - common)


def _least_common(a: list[int], b: list[int]) -> int:
    return min(set(a).intersection(b))


def _among(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is asked for, and a few others: a bitmap of bounded size is broadcast, so that few rows are shuffled."""
    at = F.pmod(F.xxhash64(key), F.lit(_FILTER_BITS))
    maps = asked.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    place = F.bitmap_bit_position(at)
    found = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.substring("bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(rows.columns)


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` for the nodes in ``wanted``, worked out from the text of a document with that set."""
    asked = nodes.join(wanted.distinct(), "node").select("text_key", "node", "set_a")
    asked = written(asked, "asked")
    keyed = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("doc_id", F.xxhash64("text"))).select("text_key", "text")
    rows = _among(keyed, asked, "text_key").join(asked, "text_key").select("node", "text", "set_a")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # the same id and text may come again
        for batch in batches:
            nodes, sets = [], []
            for node, text, a in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if node in done:
                    continue
                found = shingle_set(text.as_py(), size)
                if int(_signed(np.array([found.sum(dtype=np.uint64)]))[0]) == a:
                    done.add(node)
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return written(rows.mapInArrow(make, "node long, shingles binary"), "sets")
