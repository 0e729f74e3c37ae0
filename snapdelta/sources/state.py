"""The stored hash state: key columns plus ``content_hash``, one row per key, laid out by key.

A run adds a tier with the keys it changed. A tier is a folder ``tier=<first>-<last>-<buckets>``: Parquet files bucketed and
sorted by key, holding the last write of each key in the runs first to last. Look-ups join the tiers as they lie, without
shuffling or sorting them anew; only the rows that are looked up are dealt to the buckets.

After a write the newest tiers are merged as long as the next older one is less than ``LIKE`` times as large as those together. So
sizes grow geometrically with age, there are a logarithm of tiers, and a key is rewritten a logarithm of times, however many the
runs. No folder is ever written twice, and folders without Spark's success marker, left by a crashed run, are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.names import quoted
from snapdelta.operators.components import latest
from snapdelta.sources.folders import child_folders, committed, remove, size

#: A tier is merged with newer ones if it is less than so many times as large as they are together.
LIKE = 2
HASH = T.StructField("content_hash", T.StringType())
_NAME = re.compile(r"tier=(\d+)-(\d+)-(\d+)")


@dataclass(frozen=True)
class Tier:
    """The runs a folder covers, first and last, and the number of its buckets."""

    first: int
    last: int
    buckets: int

    @property
    def name(self) -> str:
        return f"tier={self.first:08d}-{self.last:08d}-{self.buckets}"


def tiers(spark: SparkSession, path: str) -> list[Tier]:
    """The tiers that count, newest first: of finished folders that end with the same run the one that begins first."""
    finished = [t for t in _folders(spark, path) if committed(spark, f"{path}/{t.name}")]
    found: list[Tier] = []
    for tier in sorted(finished, key=lambda t: (-t.last, t.first)):
        if not found or tier.last < found[-1].first:
            found.append(tier)
    return found


def has_state(spark: SparkSession, path: str) -> bool:
    """Whether any state was ever saved."""
    return bool(tiers(spark, path))


def open_state(spark: SparkSession, path: str, key: Sequence[T.StructField]) -> list[DataFrame]:
    """The tiers as frames bucketed by key, newest first, for ``delta.with_prior``. A key counts in the first that has it."""
    return [_named(_read(spark, path, tier, key), key) for tier in tiers(spark, path)]


def load_state(spark: SparkSession, path: str, key: Sequence[T.StructField]) -> DataFrame:
    """The current state as one frame; an empty frame of the right type if none was ever saved."""
    found = [_read(spark, path, tier, key) for tier in tiers(spark, path)]
    return _named(_last_writes(found), key) if found else spark.createDataFrame([], T.StructType([*key, HASH]))


def save_state(
    spark: SparkSession, path: str, updates: DataFrame, key: Sequence[T.StructField], buckets: int | None = None
) -> str:
    """Store the hashes of changed keys, each key once in ``updates``. Returns the folder written.

    The number of buckets is that of the newest tier, and at the first write the session's number of shuffle partitions, unless given.
    """
    known = tiers(spark, path)
    buckets = buckets or (known[0].buckets if known else int(spark.conf.get("spark.sql.shuffle.partitions")))
    serial = _next(spark, path)
    added = Tier(serial, serial, buckets)
    _write(updates.select(*[quoted(f.name) for f in key], HASH.name), path, added)
    alike = like_tiers([size(spark, f"{path}/{t.name}") for t in [added, *known]])
    if alike == 1:
        return f"{path}/{added.name}"
    merged = Tier(known[alike - 2].first, serial, buckets)
    _write(_last_writes([_read(spark, path, t, key) for t in [added, *known][:alike]]), path, merged)
    return f"{path}/{merged.name}"


def like_tiers(sizes: Sequence[int]) -> int:
    """How many of the newest tiers, given newest first, are to become one."""
    total, alike = sizes[0], 1
    while alike < len(sizes) and sizes[alike] < LIKE * total:
        total += sizes[alike]
        alike += 1
    return alike


def rebucket(spark: SparkSession, path: str, key: Sequence[T.StructField], buckets: int) -> str:
    """Put the whole state into one tier with another number of buckets, for a state that has outgrown its own."""
    known = tiers(spark, path)
    whole = Tier(known[-1].first if known else 1, _next(spark, path), buckets)
    _write(load_state(spark, path, key), path, whole)
    return f"{path}/{whole.name}"


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders that no later reader needs, finished or not; returns their names.

    For a time when no job reads or writes the store: a frame planned before may still name them.
    """
    kept = tiers(spark, path)
    old = sorted(t.name for t in _folders(spark, path) if kept and t.last <= kept[0].last and t not in kept)
    for name in old:
        remove(spark, f"{path}/{name}")
    return old


def _folders(spark: SparkSession, path: str) -> list[Tier]:
    found = (_NAME.fullmatch(name) for name in child_folders(spark, path))
    return [Tier(*map(int, match.groups())) for match in found if match]


def _next(spark: SparkSession, path: str) -> int:
    return max((t.last for t in _folders(spark, path)), default=0) + 1


def _last_writes(newest_first: Sequence[DataFrame]) -> DataFrame:
    if len(newest_first) == 1:
        return newest_first[0]
    parts = [df.withColumn("_age", F.lit(-age)) for age, df in enumerate(newest_first)]
    names = [n for n in newest_first[0].columns if n != HASH.name]
    # A key occurs once per tier, so combining before the shuffle would only cost a sort.
    dealt = reduce(DataFrame.unionByName, parts).repartition(*names)
    return latest(dealt, names, ["_age"], [HASH.name])


def _named(rows: DataFrame, key: Sequence[T.StructField]) -> DataFrame:
    return rows.toDF(*[f.name for f in key], HASH.name)


def _write(rows: DataFrame, path: str, tier: Tier) -> None:
    """One file a bucket, by way of a table that is forgotten again: its folder is its own description."""
    names = [f"key_{position}" for position in range(len(rows.columns) - 1)]
    rows = rows.toDF(*names, HASH.name).repartition(tier.buckets, *names)
    table = _table()
    writer = rows.write.format("parquet").bucketBy(tier.buckets, *names).sortBy(*names)
    writer.option("path", f"{path}/{tier.name}").saveAsTable(table)
    rows.sparkSession.sql(f"DROP TABLE {table}")


def _read(spark: SparkSession, path: str, tier: Tier, key: Sequence[T.StructField]) -> DataFrame:
    """A tier with its buckets known to the planner. The frame outlives the table that describes it.

    Key columns go by their position in the files, so that any name may be a key's.
    """
    names = [f"key_{position}" for position in range(len(key))]
    columns = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip([*names, HASH.name], [*key, HASH], strict=True))
    clustered, table = ", ".join(names), _table()
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (path '{_escaped(f'{path}/{tier.name}')}')"
        f" CLUSTERED BY ({clustered}) SORTED BY ({clustered}) INTO {tier.buckets} BUCKETS"
    )
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _table() -> str:
    return f"snapdelta_state_{uuid.uuid4().hex}"
