"""A hash tree over the rows of a dataset, and what becomes of its root when a row is tampered with.

Every source has a tree over its rows in order of id, and a tree over their roots gives the root of the dataset. Nodes are
never changed: a tampered leaf makes a version of the tree that shares all nodes but its own ancestors, which are copied. Leaves are
dealt in aligned blocks, whole subtrees of fixed height; a task builds the nodes of a block and copies paths within it, and
continues every version along the path of its block, which comes from the same procedure over the blocks' roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.common import tasks, written

#: Nodes that are hashed together, and levels of the tree that a block holds (3 ** 7 = 2,187 leaves).
ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before: string, after: string>>"


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build(leaves: Sequence[str], height: int | None = None) -> list[list[str]]:
    """The nodes of a tree level by level: up to a single one, or of just ``height`` levels above the leaves."""
    rows = [list(leaves)]
    while len(rows[-1]) > 1 if height is None else len(rows) <= height:
        below = rows[-1]
        rows.append([_hash(*below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
    return rows


def siblings(rows: list[list[str]], leaf: int) -> list[tuple[str, str]]:
    """The digests before and after a leaf and its ancestors among the children of one node, from the leaf upwards."""
    path = []
    for row in rows[:-1]:
        first = leaf - leaf % ARITY
        path.append(("".join(row[first:leaf]), "".join(row[leaf + 1 : first + ARITY])))
        leaf //= ARITY
    return path


def copied(leaf: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes that a version has of its own: the leaf, a copy of every ancestor, the last of them its root."""
    nodes = [leaf]
    for before, after in path:
        nodes.append(_hash(before, nodes[-1], after))
    return nodes


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, id_col: str, source_col: str, fields: Sequence[str], text_col: str) -> DataFrame:
    """``tree`` (its order is that of the sources, null first), ``doc_id``, ``leaf``, and ``altered``: the leaf after
    tampering, null where nothing changes."""
    others = {name: _field(docs[name]) for name in fields}
    tampered = others | {text_col: _field(F.replace(docs[text_col], F.lit("\n"), F.lit("")))}
    chosen = F.crc32(docs[id_col].cast("long").cast("string").cast("binary")) % 2 == 0
    return docs.select(
        F.when(docs[source_col].isNull(), "").otherwise(F.concat(F.lit("s"), docs[source_col].cast("string"))).alias("tree"),
        docs[id_col].cast("long").alias("doc_id"),
        F.sha2(F.concat(*others.values()), 256).alias("leaf"),
        F.when(chosen & docs[text_col].contains("\n"), F.sha2(F.concat(*tampered.values()), 256)).alias("altered"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, the number of a row within its ``tree`` from 0, and ``n``, the rows of the tree.

    One range shuffle over tree and order; what sits before a partition is summed up from a row per partition and tree, so that
    no window holds more rows than there are partitions. Rows that are alike are told apart, so that they do not meet in one task.
    """
    order = ["tree", *order, "tie"]
    told = written(rows, "unplaced").withColumn("tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")
    runs = dealt.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"base": F.coalesce(before, F.lit(0)), "n": F.sum("rows").over(tree)}).drop("rows")
    joined = dealt.join(runs, ["part", "tree"])
    return joined.withColumn("place", F.col("at") - F.col("first") + F.col("base")).drop("part", "at", "first", "base", "tie")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place DIV {ARITY**levels}"))


def _height(n: int, levels: int) -> int | None:
    """A block of a larger tree is of full height, a tree that is one block ends where one node is left."""
    return levels if n > ARITY**levels else None


def _rows(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the aligned blocks, as the leaves of the tree above: ``tree, place, n, leaf``."""

    def root(block: pa.Table) -> pa.Table:
        block = _rows(block)
        n = block["n"][0].as_py()
        top = build(block["leaf"].to_pylist(), _height(n, levels))[-1][0]
        above = -(-n // ARITY**levels)
        return pa.Table.from_pylist([{"tree": block["tree"][0].as_py(), "place": block["block"][0].as_py(), "n": above, "leaf": top}])

    rows = _blocks(nodes.select("tree", "place", "n", "leaf"), levels)
    return rows.groupBy("tree", "block").applyInArrow(root, "tree string, place long, n long, leaf string")


def paths_of_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, block, path, root``: the siblings from the root of each block up to the root of its tree."""
    roots = written(block_roots(nodes, levels), "block-roots")
    most = roots.agg(F.max("n")).first()[0]
    if (most or 1) == 1:
        return roots.select("tree", F.col("place").alias("block"), F.array().cast(_PATH).alias("path"), F.col("leaf").alias("root"))
    return paths(roots, levels).withColumnRenamed("place", "block")


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, place, path, root`` of every node: its siblings and its ancestors' up to the root of its tree."""

    def climb(block: pa.Table, above: pa.Table) -> pa.Table:
        block, rest, top = _rows(block), _path(above), above["root"][0].as_py()
        tree = build(block["leaf"].to_pylist(), _height(block["n"][0].as_py(), levels))
        whole = [[{"before": b, "after": a} for b, a in siblings(tree, k) + rest] for k in range(len(block))]
        found = {"tree": block["tree"].to_pylist(), "place": block["place"].to_pylist(), "path": whole, "root": [top] * len(block)}
        return pa.table(found, pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", _arrow_path()), ("root", pa.string())]))

    upper = paths_of_blocks(nodes, levels)
    met = _blocks(nodes, levels).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    return written(met.applyInArrow(climb, f"tree string, place long, path {_PATH}, root string"), "paths")


def _arrow_path() -> pa.DataType:
    return pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _path(above: pa.Table) -> list[tuple[str, str]]:
    return [(step["before"], step["after"]) for step in above["path"][0].as_py()]


def versions(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, text_col: str = "text",
    nodes: bool = False, levels: int = LEVELS,
) -> DataFrame:
    """One row per document: doc_id, its leaf, the root of its source (subroot), the root of all, the hash of the siblings that
    prove it, the root of the version its tampered leaf makes (folded_root), and whether that is the root of all (verified).

    Tampering takes the line ends out of the text where 2 divides the crc32 of the id. With ``nodes``, also ``proof``, the siblings level by level,
    and ``copied``, the nodes that the version does not share, from the leaf to the root. ``levels`` is the height of a block. A null source is a tree of its
    own, before all others; a null id is before all others and never tampered with; a null text stays. Equal ids go by their leaves, and rows
    repeated in full are leaves of their own. A text is hashed whole, whatever its length. A lone leaf is its subroot. Other
    columns do not matter. An empty table gives no rows.
    """
    rows = placed(leaves(docs, id_col, source_col, fields, text_col), ["doc_id", "leaf"])
    in_source = written(paths_of_blocks(rows, levels), "source-paths")
    subroots = in_source.select("tree", "root").distinct().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("leaf"))
    tops = placed(subroots, ["of"])
    to_root = paths(tops, levels).join(tops.select("place", "of"), "place")
    to_root = to_root.select(F.col("of").alias("tree"), F.col("path").alias("top_path"), F.col("root").alias("top"))
    upper = in_source.join(to_root, "tree").select(
        "tree", "block", F.concat("path", "top_path").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root")
    )

    def verify(block: pa.Table, above: pa.Table) -> pa.Table:
        block, rest = _rows(block), _path(above)
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        own = block["leaf"].to_pylist()
        tree = build(own, _height(block["n"][0].as_py(), levels))
        found = []
        for k, (doc_id, leaf, altered) in enumerate(zip(block["doc_id"].to_pylist(), own, block["altered"].to_pylist(), strict=True)):
            path = siblings(tree, k) + rest
            version = copied(altered or leaf, path)
            proof = _hash(*(before + after for before, after in path))
            row = {"doc_id": doc_id, "leaf": leaf, "subroot": subroot, "root": root, "proof_sha256": proof}
            row |= {"folded_root": version[-1], "verified": version[-1] == root}
            if nodes:
                row |= {"proof": [{"before": b, "after": a} for b, a in path], "copied": version}
            found.append(row)
        return pa.Table.from_pylist(found, arrow)

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    columns = [("doc_id", pa.int64()), *((name, pa.string()) for name in names), ("verified", pa.bool_())]
    schema = "doc_id long, " + ", ".join(f"{name} string" for name in names) + ", verified boolean"
    if nodes:
        columns += [("proof", _arrow_path()), ("copied", pa.list_(pa.string()))]
        schema += f", proof {_PATH}, copied array<string>"
    arrow = pa.schema(columns)
    return _blocks(rows, levels).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(verify, schema)
