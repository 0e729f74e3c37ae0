"""Embeddings within a cosine of each other, exactly: a metric range join by pivots.

On unit vectors a least cosine is a greatest distance, and a greatest angle. Every label gets pivots, chosen far from each other, and
every vector belongs to the cell of its nearest one. Of each cell the least and greatest angle of its vectors to every pivot are kept. By
the triangle inequality a vector has a partner in a cell only if its own angle to each pivot is within reach of these (the cell's own pivot
gives its radius), and only if it is within reach of the cell's side of the plane between its pivot and any other: (v.q - v.p) / d(q, p) is
at most the range. Where all that holds it is a guest of the cell; so cells join independently and nothing is missed.

How many pivots a label gets is found on a sample: as many as make comparing and copying together least, two at least. Vectors spread evenly
in many dimensions are nearly all within reach of every cell, and few pivots are best; clustered ones are guests of few cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import components, matched, spread, written

#: Vectors of a label from which pivots are chosen, about; pivots of a label at most; vectors placed in one group; and bytes of
#: vectors of a cell that are compared in one task.
SAMPLE, MOST_PIVOTS, PART, BLOCK_BYTES = 1024, 128, 8192, 4 << 20
#: What comparing a pair costs for each dimension, and what a copy of a vector costs for each and at least, in the same unit of time.
PAIR_COST, COPY_COST, COPY_LEAST = 0.2, 10.0, 10_000.0
#: Products of one comparison at most, least distance of two pivots, and what is allowed for rounding of angles.
PRODUCTS, LEAST_GAP, SLACK = 1 << 22, 1e-3, 1e-6


def _unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length one in double precision; none if it is zero or not finite."""
    v = np.asarray(values, np.float64)
    top = np.abs(v).max(initial=0.0)
    if not len(v) or not np.isfinite(top) or top == 0 or np.isnan(v).any():
        return None
    v = v / top  # neither tiny nor huge components lose their square
    return v / np.sqrt(v @ v)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``uid, label, dims, unit`` of the vectors that have a direction; ``unit`` is packed doubles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, label, dims, unit = [], [], [], []
            for u, name, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = vector.values
                if values is None or values.null_count:
                    continue
                found = _unit(values.to_numpy(zero_copy_only=False))
                if found is not None:
                    uid.append(u)
                    label.append(name)
                    dims.append(len(found))
                    unit.append(found.tobytes())
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((uid, label, dims, unit), kinds, strict=True)], names=["uid", "label", "dims", "unit"]
            )

    return rows.mapInArrow(make, "uid long, label string, dims int, unit binary")


def _matrix(table: pa.Table, column: str = "unit") -> np.ndarray:
    rows = table[column].to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _angles(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1, 1))


def _spread_out(vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``vectors`` in an order in which each is as far as can be from all before; no two as good as equal."""
    chosen, least = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < most:
        far = int(least.argmax())
        if least[far] < LEAST_GAP:
            break
        chosen.append(far)
        least = np.minimum(least, np.linalg.norm(vectors - vectors[far], axis=1))
    return vectors[chosen]


class Cells:
    """The pivots of a label, and the least and greatest angle of each cell's vectors (rows) to each pivot (columns)."""

    def __init__(self, pivots: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.pivots, self.low, self.high = pivots, low, high
        self.gaps = np.stack([np.linalg.norm(pivots - p, axis=1) for p in pivots])
        np.fill_diagonal(self.gaps, 1)

    def ranges(self, products: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, angles = len(self.pivots), _angles(products)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        np.minimum.at(low, own, angles)
        np.maximum.at(high, own, angles)
        return low, high

    def visits(self, products: np.ndarray, own: np.ndarray, reach: float, turn: float) -> np.ndarray:
        """Which cells each vector (rows) is in or a guest of, for a greatest distance and a greatest angle."""
        angles = _angles(products)
        found = np.empty(products.shape, bool)
        for cell in range(len(self.pivots)):
            within = (angles >= self.low[cell] - turn - SLACK) & (angles <= self.high[cell] + turn + SLACK)
            beyond = (products - products[:, [cell]]) / self.gaps[cell] > reach + 1e-9
            found[:, cell] = within.all(axis=1) & ~beyond.any(axis=1)
        found[np.arange(len(own)), own] = True
        return found


def choose(sample: np.ndarray, n: int, reach: float, turn: float, pair_cost: float) -> np.ndarray:
    """The pivots of a label of ``n`` vectors, by the costs that a sample of them shows."""
    most = max(2, min(MOST_PIVOTS, n // 2, 2 * int(np.sqrt(n))))
    order, dims = _spread_out(sample, most), sample.shape[1]
    best, least, k = order[:2], np.inf, 2
    while True:
        cells = Cells(order[:k])
        products = sample @ cells.pivots.T
        own = products.argmax(axis=1)
        cells.low, cells.high = cells.ranges(products, own)
        visits = cells.visits(products, own, reach, turn)
        sizes, home = visits.sum(axis=0) / len(sample), np.bincount(own, minlength=len(cells.pivots)) / len(sample)
        cost = n * float(home @ sizes) * pair_cost * dims + float(sizes.sum()) * (COPY_COST * dims + COPY_LEAST)
        if cost < least:
            best, least = cells.pivots, cost
        if k >= len(order):
            return best
        k = min(2 * k, len(order))


def pivots(nodes: DataFrame, sizes: DataFrame, reach: float, turn: float, pair_cost: float = PAIR_COST) -> DataFrame:
    """``label, dims, n, pivots``, a row per label: its pivots, packed one after the other.

    The sample is all vectors of a label whose hash is small enough to leave about ``SAMPLE`` of them, so it is bounded whatever the label.
    """
    part = F.pmod(F.xxhash64(F.lit(5), "unit"), F.lit(1 << 30))
    sample = matched(nodes, sizes, ["label", "dims"], "n").where(part * F.col("n") <= SAMPLE << 30)

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        found = choose(_matrix(rows), rows["n"][0].as_py(), reach, turn, pair_cost)
        return rows.slice(0, 1).select(["label", "dims", "n"]).append_column("pivots", pa.array([found.tobytes()], pa.binary()))

    chosen = sample.select("label", "dims", "n", "node", "unit").groupBy("label", "dims")
    return written(chosen.applyInArrow(pick, "label string, dims int, n long, pivots binary"), "pivots")


def _parts(rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors dealt to bounded parts of their label, and what belongs to the label given to each part."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = matched(rows, cells.select("label", "dims", "n"), ["label", "dims"], "n")
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("n")
    return own, cells.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


_KEY = ["label", "dims", "part"]


def homes(nodes: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vector with its cell, and the pivots with the ranges of their cells: ``label, dims, n, pivots, ranges``."""

    def place(rows: pa.Table, label: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], _PLACED)
        cells = Cells(_matrix(label, "pivots").reshape(-1, rows["dims"][0].as_py()))
        products = _matrix(rows) @ cells.pivots.T
        own = products.argmax(axis=1)
        low, high = cells.ranges(products, own)
        placed = rows.select(["label", "dims", "node", "copies", "unit"]).append_column("cell", pa.array(own, pa.int32()))
        held = np.unique(own)
        first = [rows["label"][0].as_py()] * len(held), [rows["dims"][0].as_py()] * len(held)
        ranges = pa.table({
            "label": pa.array(first[0], pa.string()), "dims": pa.array(first[1], pa.int32()), "cell": pa.array(held, pa.int32()),
            "low": pa.array(low[held].tolist(), pa.list_(pa.float64())), "high": pa.array(high[held].tolist(), pa.list_(pa.float64())),
        })
        return pa.concat_tables([placed, ranges], promote_options="default").select(_PLACED.names).cast(_PLACED)

    schema = "label string, dims int, cell int, node long, copies long, unit binary, low array<double>, high array<double>"
    own, given = _parts(nodes, pivots)
    found = written(own.groupBy(*_KEY).cogroup(given.groupBy(*_KEY)).applyInArrow(place, schema), "homes")
    each = found.where("node IS NULL").select("label", "dims", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "range"))
    ranges = each.groupBy("label", "dims", "cell", "pivot").agg(F.min("range.low").alias("low"), F.max("range.high").alias("high"))
    # As many as the square of the pivots of a label.
    ranges = ranges.groupBy("label", "dims").agg(F.collect_list(F.struct("cell", "pivot", "low", "high")).alias("ranges"))
    return found.where("node IS NOT NULL").drop("low", "high"), pivots.join(ranges, ["label", "dims"])


_PLACED = pa.schema([
    ("label", pa.string()), ("dims", pa.int32()), ("cell", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()),
    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
])


def _goes(own, other):
    """Of two cells, or blocks, whose vectors go to the other one: each pair of vectors meets once, and each goes to half of the others."""
    return (other != own) & ((other < own) ^ ((own + other) % 2 == 1))


def guests(placed: DataFrame, cells: DataFrame, reach: float, turn: float) -> DataFrame:
    """Every vector once for each cell it goes to as a guest: ``label, dims, cell, node, copies, unit, rep``."""
    names = ["label", "dims", "cell", "node", "copies", "unit", "rep"]

    def visit(rows: pa.Table, label: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], arrow)
        dims = rows["dims"][0].as_py()
        here = Cells(_matrix(label, "pivots").reshape(-1, dims))
        k = len(here.pivots)
        here.low, here.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for r in label["ranges"][0].as_py():
            here.low[r["cell"], r["pivot"]], here.high[r["cell"], r["pivot"]] = r["low"], r["high"]
        own = np.array(rows["cell"].to_pylist())
        visits = here.visits(_matrix(rows) @ here.pivots.T, own, reach, turn)
        at, cell = np.nonzero(visits & _goes(own[:, None], np.arange(k)))
        return rows.take(pa.array(at)).drop_columns(["cell"]).append_column("cell", pa.array(cell, pa.int32())).select(names).cast(arrow)

    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    arrow = pa.schema(list(zip(names, kinds, strict=True)))
    own, given = _parts(placed.select(*names), cells)
    met = own.groupBy(*_KEY).cogroup(given.groupBy(*_KEY))
    return met.applyInArrow(visit, "label string, dims int, cell int, node long, copies long, unit binary, rep long")


_BLOCK = ["label", "dims", "cell", "block"]


def _blocks(rows: DataFrame, sizes: DataFrame, each: bool) -> DataFrame:
    """Vectors dealt to the blocks of their cell, or with ``each`` given to every block."""
    dealt = matched(rows, sizes, ["label", "dims", "cell"], "n")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if each else own)


def _unite(group: np.ndarray, mine: np.ndarray) -> None:
    """Let all members of the groups of some rows be of one group."""
    groups = group[mine]
    if len(groups) and (groups != groups[0]).any():
        group[np.isin(group, groups)] = groups.min()


def within_blocks(blocks: DataFrame, least_cosine: float) -> DataFrame:
    """Each block's vectors against each other: adds ``links``, and ``rep``, the first vector that a vector is connected with there."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        units, copies = _matrix(rows), np.array(rows["copies"].to_pylist())
        links, group = np.zeros(len(units), np.int64), np.arange(len(units))
        step = max(1, PRODUCTS // len(units))
        for k in range(0, len(units), step):
            near = units[k : k + step] @ units.T >= least_cosine
            near[np.arange(len(near)), np.arange(k, k + len(near))] = False
            links[k : k + step] = near @ copies
            for i in np.flatnonzero(near.any(axis=1)):
                _unite(group, np.append(np.flatnonzero(near[i]), k + i))
        node = np.array(rows["node"].to_pylist())
        return rows.append_column("links", pa.array(links)).append_column("rep", pa.array(node[group]))

    schema = "label string, dims int, cell int, block int, node long, copies long, unit binary, links long, rep long"
    names = [*_BLOCK, "node", "copies", "unit"]
    return written(blocks.select(*names).groupBy(*_BLOCK).applyInArrow(compare, schema), "within")


def across(placed: DataFrame, others: DataFrame, least_cosine: float) -> DataFrame:
    """Each block's vectors against guests and other blocks of the cell: ``node, other, links``.

    A row with ``links`` counts for a vector, of the block or a guest; one without connects two ``rep``, once however many links they have.
    """
    own = placed.select(*_BLOCK, F.lit(0).alias("kind"), "node", "copies", "unit", "rep")
    both = own.unionByName(others.select(*_BLOCK, F.lit(1).alias("kind"), "node", "copies", "unit", "rep"))
    both = spread(both, *_BLOCK).sortWithinPartitions(*_BLOCK, "kind", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:4]):
            home, waiting, state = [], [], None
            for r in group:
                if r[4] == 0:
                    home.append(r[5:])
                    continue
                if not home:  # guests of a block that holds nothing
                    continue
                state = state or _Block(home, least_cosine)
                waiting.append(r[5:])
                if len(waiting) >= state.step:
                    state.meet(waiting)
                    waiting = []
            if state:
                state.meet(waiting)
                yield state.result()

    return written(both.mapInArrow(compare, "node long, other long, links long"), "across")


class _Block:
    """The vectors of one block and what they have met."""

    def __init__(self, rows: list[tuple], least_cosine: float):
        self.nodes, self.copies, self.reps = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        self.units = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
        self.least, self.step = least_cosine, max(1, PRODUCTS // len(rows))
        self.links = np.zeros(len(rows), np.int64)
        self.guests: list[tuple[int, int]] = []
        self.edges: set[tuple[int, int]] = set()

    def meet(self, rows: list[tuple]) -> None:
        if not rows:
            return
        near = self.units @ np.stack([np.frombuffer(r[2], np.float64) for r in rows]).T >= self.least
        at, guest = np.nonzero(near)
        if not len(at):
            return
        nodes, copies, reps = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        self.links += near @ copies
        met = np.unique(guest)
        self.guests += zip(nodes[met].tolist(), (self.copies @ near[:, met]).tolist(), strict=True)
        pairs = np.unique(np.stack([self.reps[at], reps[guest]], axis=1), axis=0)
        self.edges.update(map(tuple, pairs.tolist()))

    def result(self) -> pa.RecordBatch:
        linked = [(n, n, k) for n, k in zip(self.nodes.tolist(), self.links.tolist(), strict=True) if k]
        rows = linked + [(n, n, k) for n, k in self.guests] + [(a, b, None) for a, b in sorted(self.edges)]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other", "links"])


def linked_embeddings(
    vectors: DataFrame, least_cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    pair_cost: float = PAIR_COST,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Compared are vectors of the same label and length whose label is not null; a vector that is null, zero, or holds a
    null or non-finite component is linked with nothing. Equal vectors are compared once and counted as often as they
    occur. ``pair_cost`` is what comparing a pair costs for each dimension, next to ``COPY_COST``; it moves the number of pivots only. Vectors
    of any length are packed whole. A null id counts as largest; its row is kept only if it is alone. An empty table gives no rows.
    """
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].alias("vector")
    )
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    units = unit_vectors(rows.where("label IS NOT NULL AND vector IS NOT NULL").select("uid", "label", "vector"))
    units = written(units.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")}), "units")
    same = ["label", "dims", "h1", "h2"]
    classes = units.groupBy(*same).agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(classes.join(units.select(F.col("uid").alias("node"), "unit"), "node"), "nodes")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    turn = float(np.arccos(min(1.0, max(-1.0, least_cosine))))
    sizes = written(nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed, cells = homes(nodes, pivots(nodes, sizes, reach, turn, pair_cost))
    cells = written(cells, "cells")
    held = placed.groupBy("label", "dims", "cell").agg(F.count(F.lit(1)).alias("n"))
    held = written(held.withColumn("blocks", F.ceil(F.col("n") * F.col("dims") * 8 / BLOCK_BYTES).cast("int")), "held")
    inside = within_blocks(_blocks(placed, held, each=False), least_cosine)
    # The vectors of a block have met each other; those of other blocks of the cell come to it like guests.
    away = _blocks(written(guests(inside, cells, reach, turn), "guests"), held, each=True)
    beside = _blocks(inside.withColumnRenamed("block", "own_block"), held.where("blocks > 1"), each=True)
    beside = beside.where("block <> own_block AND (block < own_block) <> ((block + own_block) % 2 = 1)")
    outside = across(inside, away.unionByName(beside.select(away.columns)), least_cosine)
    counts = inside.select("node", "links").unionByName(outside.where("links IS NOT NULL").select("node", "links"))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    edges = inside.select(F.col("node").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.unionByName(outside.where("links IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    known = nodes.select("node", *same, "copies").join(counts, "node").join(labels, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node")).drop("node")
    known = written(known, "known")
    placed = matched(units.select("uid", *same), known, same, "copies")
    full = rows.select("uid", "vec_id").join(placed, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    full = written(full.select("uid", "vec_id", "component", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")), "linked")
    least = full.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("members") == 1)
    found = matched(full, written(least, "least"), ["component"], "members")
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))
