"""Transforms shared by the flows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.stamps import stamp_of_micros, timestamp_literal
from snapdelta.functions.status import REQUIRED_MISSING, RESULT, require
from snapdelta.operators.components import COMPONENTS, has_component, set_component
from snapdelta.operators.delta import changed, stamp
from snapdelta.operators.versions import latest_version, version_lines, with_versions
from snapdelta.plans.stages import Stage, Transform
from snapdelta.sources import folders, state
from snapdelta.sources.log import load_log

# The names of the stages.
DISCOVERY = "File Discovery"
HASHING = "Hash Calculation"
DECISION = "Backup Decision"
EXECUTION = "Backup Execution"
QUERY = "Query Backup Dates"
RESTORE = "Restore"


def decide(required: Sequence[str], run_ts: dt.datetime | None = None, stamp_col: str | None = None) -> Transform:
    """Stamp the rows whose hash differs from the stored one.

    The stamp is the time of the run, one value for all rows, or a time of each row's own from
    ``stamp_col``, where there is one. Rows without the ``required`` components fail.
    """
    moments = [F.col(stamp_col).cast("timestamp")] if stamp_col else []
    moment = F.coalesce(*moments, *([timestamp_literal(run_ts)] if run_ts else []))

    def transform(df: DataFrame) -> DataFrame:
        complete = has_component(*required)
        differs = complete & changed(F.col("file_hash.current_hash"), F.col("file_hash.previous_hash"))
        marked = set_component(df, "backup_date", stamp(differs, moment), where=differs)
        return marked.withColumn(RESULT, require(complete, REQUIRED_MISSING))

    return transform


def gather(df: DataFrame) -> DataFrame:
    """Put short rows from maybe very many tasks into few files, for a stage that cuts."""
    return df.hint("rebalance")


def list_versions(log: DataFrame) -> Stage:
    """A stage that gives every entity the list of all version dates, newest first; an empty log gives an empty list."""
    return Stage(QUERY, [lambda entities: with_versions(entities, log)], components=component_types("backup_dates"))


def query_versions(spark: SparkSession, store: str) -> DataFrame:
    """The version dates in a store's log, newest first, each with its place and display line."""
    return version_lines(load_log(spark, f"{store}/log"))


def newest_version(spark: SparkSession, store: str) -> str | None:
    """Name of the newest version in a store's log; None if the log is empty."""
    newest = latest_version(load_log(spark, f"{store}/log"))
    moment = newest.select(F.unix_micros("backup_date")).first()[0]
    return None if moment is None else stamp_of_micros(moment)


def vacuum(spark: SparkSession, store: str) -> list[str]:
    """Remove the folders of a store's state and log that no reader needs any more; versions stay."""
    old = [f"state/{name}" for name in state.vacuum(spark, f"{store}/state")]
    return old + [f"log/{name}" for name in folders.vacuum(spark, f"{store}/log")]


def component_types(*names: str) -> dict[str, str]:
    """Declarations of the named built-in components."""
    return {name: COMPONENTS[name] for name in names}
