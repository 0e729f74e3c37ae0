"""The version log, version lookup and last-write-wins within a version."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.status import NO_VERSIONS, VERSION_NOT_FOUND, require
from snapdelta.functions.stamps import display_date
from snapdelta.operators.components import latest, set_component
from snapdelta.session import checkpointed


def log_add(log: DataFrame, new: DataFrame) -> DataFrame:
    """Version dates with further dates added; duplicates collapse."""
    return log.select("backup_date").unionByName(new.select("backup_date")).distinct()


def list_versions(log: DataFrame) -> DataFrame:
    """Distinct version dates, newest first, by a distributed sort."""
    return log.select("backup_date").distinct().orderBy(F.desc("backup_date"))


def version_lines(log: DataFrame) -> DataFrame:
    """One display line per stored date with its place in the list, newest first, in this order.

    The dates are dealt to ranges, sorted within each and kept so (``session.checkpointed``, which makes this run at once). A place is
    that within the range plus the dates in later ranges, of which the driver sums up one count each. No window, and no second sort.
    """
    spark = log.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    newest_first = F.desc("backup_date")
    dates = log.select("backup_date").where("backup_date IS NOT NULL").distinct()
    dates = checkpointed(dates.repartitionByRange(ranges, newest_first).sortWithinPartitions(newest_first))
    counts = dict(dates.groupBy(F.spark_partition_id()).count().collect())
    before = list(accumulate((counts.get(part, 0) for part in range(ranges - 1)), initial=0))
    # The number of a row is that of its partition, shifted, plus its place there.
    numbered = dates.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    position = F.get(F.array(*map(F.lit, before)).cast("array<long>"), part) + place + 1
    return numbered.select(position.alias("position"), "backup_date", display_date(F.col("backup_date")).alias("line"))


def versions_component(log: DataFrame) -> DataFrame:
    """The ``backup_dates`` component: all dates as one list, newest first, empty for an empty log.

    One row that holds the log, meant for a log with a date per run. Use ``list_versions`` where
    every row of a table has a date of its own.
    """
    dates = F.sort_array(F.collect_set("backup_date"), asc=False)
    return log.agg(F.struct(dates.alias("dates")).alias("backup_dates"))


def with_versions(entities: DataFrame, log: DataFrame) -> DataFrame:
    """Set the ``backup_dates`` component of every entity to the list of all dates. The list is made once, as a scalar subquery."""
    return set_component(entities, "backup_dates", versions_component(log).scalar())


def latest_version(log: DataFrame) -> DataFrame:
    """One row: the newest date, or NULL with a failed status when there is none."""
    newest = log.agg(F.max("backup_date").alias("backup_date"))
    return newest.withColumn("_result", require(F.col("backup_date").isNotNull(), NO_VERSIONS))


def check_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requested versions with a status: failed where the version does not exist."""
    known = versions.select("version").distinct().withColumn("_known", F.lit(True))
    checked = requests.join(known, "version", "left")
    return checked.withColumn("_result", require(F.col("_known"), VERSION_NOT_FOUND)).drop("_known")


def last_wins(rows: DataFrame, path: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of several copies under one path, the last one by ``order``; other paths stay as they are."""
    payload = [c for c in rows.columns if c not in path]
    return latest(rows, path, order, payload).select(*rows.columns)
