"""What the operators share: narrow inputs, written intermediate tables, links to components."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.names import quoted
from snapdelta.session import scratch_dir

#: The white space that separates words in all word-based operators: space and the controls 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names; other columns, whatever their names, do not matter from here on."""
    short_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def document(docs: DataFrame) -> Column:
    """A row with all its columns, whatever their names, as one struct column ``document``."""
    return F.struct(*[docs[quoted(c)].alias(c) for c in docs.columns]).alias("document")


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of 2,000 rows unless the session says otherwise: 10,000 whole texts at once take
    an executor some hundred MB for each task."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case. ``bytes.split`` splits at exactly ``SPACES``."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared scratch folder and read again, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, re.sub("[^a-z0-9]+", "-", purpose))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deal rows by key over as many tasks as the session shuffles to, not merged at run time."""
    return df.repartition(tasks(df.sparkSession), *keys)


def matched(rows: DataFrame, groups: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """``rows`` with what a written table of their groups says, a row per ``key``, of which ``size`` is the number of rows.

    A group with more than a thousandth of all rows would be one task: there are fewer than a thousand of these, which are broadcast.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * 1000 > total)
    rest = rows.join(F.broadcast(large.select(*key)), list(key), "left_anti")
    return rows.join(F.broadcast(large), list(key)).unionByName(rest.join(groups.where(F.col(size) * 1000 <= total), list(key)))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Smallest id reachable, for each id that has a link: ``node, component``.

    ``links`` has long columns ``a`` and ``b``. Alternating large-star and small-star rounds; each is a few
    joins and aggregates on (node, smallest neighbour), so that a hub with a third of all links is summed
    up in a partial step before the shuffle. Ends when nothing changes; the number of rounds grows with
    the logarithm of the longest path. A round writes its links, which cuts the lineage.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_min.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        state = tuple(
            edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.countDistinct("a")).first()
        )
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
