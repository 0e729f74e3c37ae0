"""What filters remove alone, together and in every order, by counting paths through the lattice of their subsets.

A state is the set of filters applied so far, an edge applies one more. Forward counts say how many orders reach a
state, backward counts how many leave it, so the orders through an edge are the product of its two ends. What an edge
removes, times the orders through it, adds up to a filter's Shapley sum; the steps of one order are edges of the same table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.llm.common import SPACES, written

#: Filters by name: SQL conditions under which a document fails, over the columns of ``measured`` and ``is_copy``.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "has_mark",
    "E": "is_copy",
}
#: All orders of the filters are listed, so their number is bounded.
MOST_FILTERS = 8


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Measures of every whole text, a row per distinct (doc_id, part, text) with the number ``n`` of its documents."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", f"[{SPACES}]+"), "")
    narrow = rows.withColumn("words", words).select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"), F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.col("text").rlike("[#$%&*|]").alias("has_mark"),
    )
    return narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``is_copy``: some smaller doc_id has the same text. A document without id is no copy and makes none.

    The least id of a text is an aggregate, and it is met by (text, id), so that a text with a third of all
    documents has no task of its own.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("is_copy", F.expr("doc_id IS NOT NULL AND is_first IS NULL"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``good`` and ``toxic``: 1 where any label of the document says so, else 0."""

    def says(name: str) -> Column:
        return F.max(F.coalesce((labels[name] == 1).cast("long"), F.lit(0)))

    by_id = labels.groupBy(labels[id_col].cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(by_id, "doc_id", "left")
    return named.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def cells(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Documents by part and by the set of filters they fail, a bit each: at most ``2 ** len(filters)`` rows a part."""
    mask = sum((F.expr(f"IF({fails}, {1 << bit}, 0)") for bit, fails in enumerate(filters.values())), F.lit(0))
    sums = (F.sum(F.col("n") * F.col(flag)).alias(flag) for flag in ("good", "toxic"))
    return rows.withColumn("mask", mask).groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def lattice(n_filters: int) -> list[tuple[int, int, int, int]]:
    """The edges: state before, bit of the filter, state after, and the orders that pass through it."""
    full = (1 << n_filters) - 1
    edges = [(state, 1 << bit, state | 1 << bit) for state in range(full) for bit in range(n_filters) if not state >> bit & 1]
    reaching, leaving = {0: 1}, {full: 1}
    # States grow in number along every edge, so each count is whole before it is passed on.
    for before, _, after in edges:
        reaching[after] = reaching.get(after, 0) + reaching[before]
    for before, _, after in reversed(edges):
        leaving[before] = leaving.get(before, 0) + leaving[after]
    return [(before, bit, after, reaching[before] * leaving[after]) for before, bit, after in edges]


def edge_counts(cells: DataFrame, n_filters: int) -> DataFrame:
    """What every edge of the lattice keeps and removes in every part, and the Shapley sum of its filter."""
    names = ("before", "bit", "after", "through")
    edges = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, edge, strict=True))) for edge in lattice(n_filters)))
    met = cells.withColumn("edge", F.explode(edges)).select("part", "mask", "n", "good", "toxic", "edge.*")
    fails, before, after = (F.expr(f"mask & {name} <> 0") for name in ("bit", "before", "after"))

    def documents(condition: Column, number: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(number)).otherwise(0)).cast("long")

    counted = met.groupBy("part", *names).agg(
        documents(~after).alias("kept"), documents(fails & ~before).alias("removed"), documents(fails & before).alias("redundant"),
        documents(F.col("mask") == F.col("bit")).alias("unique_fails"),
        documents(fails & ~before, "good").alias("good_lost"), documents(fails & ~before, "toxic").alias("toxic_lost"),
    )
    shapley = counted.groupBy("part", "bit").agg(F.sum(F.col("through") * F.col("removed")).alias("shapley"))
    return counted.join(shapley, ["part", "bit"])


def steps(spark: SparkSession, names: list[str]) -> DataFrame:
    """Every order of the filters, step by step: ``filter_order, step, before, bit``."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, bit in enumerate(order, 1):
            rows.append(("".join(names[k] for k in order), step, state, 1 << bit))
            state |= 1 << bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step: documents kept after it, removed by it, failing its filter but
    removed earlier (redundant), failing its filter only, good and toxic ones removed, and the filter's Shapley sum.

    A null text is an empty one and a null part the empty string. A text is a copy if a smaller id has the same one;
    equal ids are no copies of each other. Rows repeated in full count each. Of several labels of an id any may say good or toxic.
    Very long texts are measured whole. Other columns do not matter. An empty table has no parts and gives no rows.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, since all their orders are listed")
    rows = written(measured(docs, id_col, text_col, part_col), "measures")
    counted = edge_counts(cells(with_labels(with_copies(rows), labels), filters), len(filters))
    # The steps are bounded by MOST_FILTERS, whatever the documents.
    orders = F.broadcast(steps(docs.sparkSession, list(filters)))
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return counted.join(orders, ["before", "bit"]).select("part", "filter_order", "step", *numbers)
