"""Versioned tables: ``<root>/snapdelta_version=<stamp>/snapdelta_batch=<n>`` folders of Parquet, and ``<root>/commits``.

A batch is what one run wrote, for one version or, where rows have stamps of their own, for many. All of it counts from the moment
its commit is there, an empty file that is made last, and nothing of it before. Two runs within one second share a
version and get a batch each, so nothing written before is touched; the later batch wins on read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.names import quoted
from snapdelta.sources.folders import child_files, child_folders, number, touch

# The hash of a row goes into a version under a name that no source column may have.
RESERVED = "_snapdelta_"
HASH_IN_VERSION = f"{RESERVED}hash"
# Folder names; a name that begins with an underscore would be hidden from readers.
VERSION, BATCH = "snapdelta_version", "snapdelta_batch"
TAKEN = (RESERVED, VERSION, BATCH)


def write_version(spark: SparkSession, root: str, version: str, *slices: DataFrame) -> int:
    """Write the rows of one version, given in one or several slices, as a new batch. Returns its number."""
    batch = _begin(spark, root)
    for rows in slices:
        rows.write.mode("append").parquet(f"{root}/{VERSION}={version}/{BATCH}={batch:08d}")
    touch(spark, f"{root}/commits/batch={batch:08d}")
    return batch


def write_versions(spark: SparkSession, root: str, version: Column, *slices: DataFrame) -> int:
    """Write rows each into the version that ``version`` names, as one new batch. Returns its number.

    A task writes a file for each version it meets, sorted by version, and content is not shuffled; have the rows
    clustered by version where a task would meet very many.
    """
    batch = _begin(spark, root)
    for rows in slices:
        named = rows.withColumns({VERSION: version, BATCH: F.lit(f"{batch:08d}")})
        named.write.mode("append").partitionBy(VERSION, BATCH).parquet(root)
    touch(spark, f"{root}/commits/batch={batch:08d}")
    return batch


def stored_versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions with at least one committed batch, oldest first."""
    names = [n.rpartition("=")[2] for n in child_folders(spark, root) if n.startswith(f"{VERSION}=")]
    known = _committed(spark, root)
    return [v for v in names if _batches(spark, root, v, known)]


def read_version(
    spark: SparkSession, root: str, version: str, key: Sequence[str], schema: T.StructType | None = None
) -> DataFrame | None:
    """The rows of one version, or None if it does not exist. No other version is opened.

    A key in several batches of the version is taken from the last one. The keys that are in several batches are
    found from key columns alone, by one aggregate; with one batch, the usual case, this is a plain scan. The hash shows as
    ``content_hash`` and the version as ``version`` unless the source has such columns of its own.
    """
    folders = _batches(spark, root, version, _committed(spark, root))
    if not folders:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [reader.parquet(f).withColumn(BATCH, F.lit(number(f))) for f in folders],
    )
    if len(folders) > 1:
        names = [quoted(k) for k in key]
        last = rows.groupBy(*names).agg(F.max(BATCH).alias("_last"), F.min(BATCH).alias("_first")).where("_first < _last")
        rows = _without_older(rows, last.select(*names, "_last"), key)
    rows = rows.drop(BATCH)
    if HASH_IN_VERSION in rows.columns:
        own = "content_hash" in rows.columns
        rows = rows.drop(HASH_IN_VERSION) if own else rows.withColumnRenamed(HASH_IN_VERSION, "content_hash")
    return rows if "version" in rows.columns else rows.withColumn("version", F.lit(version))


def read_batch(spark: SparkSession, root: str, batch: int, schema: T.StructType) -> DataFrame:
    """Some columns of the rows of one batch, from all the versions it wrote."""
    return spark.read.schema(schema).parquet(f"{root}/{VERSION}=*/{BATCH}={batch:08d}")


def _without_older(rows: DataFrame, last: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows but for those whose key is in a later batch."""
    a, b = rows.alias("a"), last.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{quoted(k)}") == F.col(f"b.{quoted(k)}") for k in key])
    return a.join(b, same & (F.col(f"a.{BATCH}") < F.col("b._last")), "left_anti")


def _begin(spark: SparkSession, root: str) -> int:
    """A number that no batch has, not even one that was never finished."""
    batch = max([number(n) for n in child_files(spark, f"{root}/commits")], default=0) + 1
    touch(spark, f"{root}/commits/begun={batch:08d}")
    return batch


def _committed(spark: SparkSession, root: str) -> set[int]:
    return {number(n) for n in child_files(spark, f"{root}/commits") if n.startswith("batch=")}


def _batches(spark: SparkSession, root: str, version: str, known: set[int]) -> list[str]:
    folder = f"{root}/{VERSION}={version}"
    return [f"{folder}/{n}" for n in child_folders(spark, folder) if number(n) in known]
