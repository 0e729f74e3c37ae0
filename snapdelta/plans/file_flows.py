"""Differential backup, version listing and restore of file trees.

Versions are plain folders, ``<destination>/<version>/<relative path>``; hash state and version log
live under an explicit ``store`` folder. A version holds what changed in that run, and restoring it
brings back exactly that.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.hashing import entity_id
from snapdelta.functions.paths import relative_path, target_path
from snapdelta.functions.stamps import stamp_of, version_stamp
from snapdelta.functions.status import (
    HASH_FAILED,
    NO_VERSIONS,
    PATH_MISSING,
    RESTORE_FAILED,
    RESULT,
    STORE_FAILED,
    VERSION_NOT_FOUND,
    fail,
    first_failure,
    ok,
    require,
)
from snapdelta.operators.components import has_component, set_component
from snapdelta.operators.delta import with_prior
from snapdelta.plans import steps
from snapdelta.plans.stages import Pipeline, Stage, Transform
from snapdelta.plans.steps import component_types, decide, gather, newest_version
from snapdelta.sources.files import copy_files, file_sha256, list_files, posix, remove_staging, spread
from snapdelta.sources.interchange import ENTRIES_PER_DOCUMENT, export_log, export_state, import_log, import_state
from snapdelta.sources.log import append_log, load_log
from snapdelta.sources.state import load_state, open_state, save_state

PATH = "file_path.file_path"
STATE_KEY = [T.StructField("path", T.StringType())]


def backup_files(
    spark: SparkSession,
    source: str,
    destination: str,
    store: str,
    run_ts: dt.datetime | None = None,
    only_written: bool = False,
    tasks: int | None = None,
    stamp_col: str | None = None,
) -> DataFrame:
    """Copy the files that are new or changed since the last run into a new version.

    Returns the entity table of the run: the seed entity and one row per file, with ``file_path``,
    ``file_hash``, ``backup_date`` on the files chosen and ``error`` on those that failed. As a rule the
    state takes every chosen file, copied or not; ``only_written=True`` leaves failed copies out, so
    that the next run tries them again.

    All files get the time of the run as their stamp, or with ``stamp_col`` one of their own, for example
    ``file_time.modified``, the time of their last change. Files go into the version of their stamp.
    """
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc)
    source, destination = posix(source), posix(destination)
    staging = f"{destination}/.staging"
    state = open_state(spark, f"{store}/state", STATE_KEY)
    stages = backup_stages(source, destination, staging, state, run_ts, tasks, stamp_col)
    report = Pipeline(stages).run(_seed(spark, source), distinct_input=True)
    remove_staging(staging)

    chosen = report.where(has_component("backup_date"))
    if only_written:
        chosen = chosen.where("error is null")
    if not chosen.isEmpty():
        hashes = chosen.select(F.col(PATH).alias("path"), F.col("file_hash.current_hash").alias("content_hash"))
        # The state last: a run that stops before it is done again.
        append_log(spark, f"{store}/log", chosen.select("backup_date.backup_date"))
        save_state(spark, f"{store}/state", hashes, STATE_KEY)
    return report


def backup_stages(
    source: str,
    destination: str,
    staging: str,
    state: DataFrame | Sequence[DataFrame],
    run_ts: dt.datetime,
    tasks: int | None = None,
    stamp_col: str | None = None,
) -> list[Stage]:
    """The four stages of a backup. Hashing and copying, the dear ones, keep what they did."""
    version = None if stamp_col else F.lit(stamp_of(run_ts))
    choose = [decide(("file_hash", "file_path"), run_ts, stamp_col), gather]
    timed = component_types("file_time") if stamp_col else {}
    return [
        Stage(steps.DISCOVERY, generators=[discover(source, tasks, bool(stamp_col))], components=timed),
        Stage(steps.HASHING, [hash_files(state, tasks)], components=component_types("file_path", "file_hash")),
        Stage(steps.DECISION, choose, components=component_types("backup_date"), cut=True),
        Stage(steps.EXECUTION, [store_files(source, destination, staging, version, tasks)], cut=True),
    ]


def restore_files(
    spark: SparkSession, destination: str, version: str | dt.datetime, target: str, tasks: int | None = None
) -> DataFrame:
    """Copy all files of one version into ``target``, over files of the same name; others stay.

    Returns the seed entity, with an error if there is no such version, and one row per file.
    """
    version = version if isinstance(version, str) else stamp_of(version)
    folder = f"{posix(destination)}/{version}"
    target = posix(target)
    staging = f"{target}/.staging"
    found = os.path.isdir(folder)
    checked = Stage(
        "Version Check",
        [lambda df: df.withColumn(RESULT, require(F.lit(found), VERSION_NOT_FOUND))],
        generators=[discover(folder, tasks)] if found else [],
    )
    copied = Stage(steps.RESTORE, [put_back(folder, target, staging, tasks)], cut=True)
    stages = [checked, copied] if found else [checked]
    restored = Pipeline(stages).run(_seed(spark, folder), distinct_input=True)
    remove_staging(staging)
    return restored


def restore_latest_files(
    spark: SparkSession, store: str, destination: str, target: str, tasks: int | None = None
) -> DataFrame:
    """Restore the newest version in the log; the seed entity fails if there is none."""
    version = newest_version(spark, store)
    if version is None:
        failed = Stage(steps.RESTORE, [lambda df: df.withColumn(RESULT, fail(NO_VERSIONS))])
        return Pipeline([failed]).run(_seed(spark, destination), distinct_input=True)
    return restore_files(spark, destination, version, target, tasks)


def import_store(spark: SparkSession, hashes: str, dates: str, store: str) -> None:
    """Take over hash state and version log from JSON files; either may be absent."""
    known = import_state(spark, hashes).withColumnRenamed("key", "path")
    if not known.isEmpty():
        save_state(spark, f"{store}/state", known, STATE_KEY)
    log = import_log(spark, dates)
    if not log.isEmpty():
        append_log(spark, f"{store}/log", log)


def export_store(
    spark: SparkSession, store: str, hashes: str, dates: str, entries_per_document: int = ENTRIES_PER_DOCUMENT
) -> None:
    """Write hash state and version log as JSON folders, with a document on each line."""
    known = load_state(spark, f"{store}/state", STATE_KEY)
    export_state(known.withColumnRenamed("path", "key"), hashes, entries_per_document)
    export_log(load_log(spark, f"{store}/log"), dates, entries_per_document)


def discover(root: str, tasks: int | None = None, times: bool = False) -> Transform:
    """Generator: a new entity with a path for each file below ``root``, per entity given; with ``times`` also its ``file_time``.

    For many entities, a file is repeated in two steps, so that no row holds more than a root of their number.
    """

    def generate(entities: DataFrame) -> DataFrame:
        n = entities.count()
        step = max(1, round(n**0.5))
        files = list_files(entities.sparkSession, root, tasks).select("path", "modified")
        if n != 1:
            starts = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))) if n else F.explode(F.array().cast("array<int>"))
            files = files.select("*", starts.alias("start"))
            last = F.least(F.col("start") + step - 1, F.lit(n - 1))
            files = files.select("path", "modified", F.explode(F.sequence("start", last)).alias("entity"))
        else:
            files = files.withColumn("entity", F.lit(0))
        time = [F.struct("modified").alias("file_time")] if times else []
        return files.select(entity_id("entity", "path").alias("entity_id"), _path_component(), *time)

    return generate


def hash_files(state: DataFrame | Sequence[DataFrame], tasks: int | None = None) -> Transform:
    """Hash each file and look up the hash stored for its path."""

    def transform(df: DataFrame) -> DataFrame:
        hashed = spread(df, PATH, tasks).select("*", F.col(PATH).alias("path"), file_sha256(PATH).alias("current_hash"))
        known = with_prior(hashed, state, ["path"])
        status = first_failure(
            require(has_component("file_path"), PATH_MISSING),
            require(F.col("current_hash").isNotNull(), HASH_FAILED),
        )
        hashes = F.struct("current_hash", "previous_hash")
        known = set_component(known, "file_hash", hashes, where=F.col("current_hash").isNotNull())
        return known.withColumn(RESULT, status).drop("path", "current_hash", "previous_hash")

    return transform


def store_files(
    source: str, destination: str, staging: str, version: Column | None = None, tasks: int | None = None
) -> Transform:
    """Copy stamped files into their version folder; rows without a stamp are left alone.

    The version is that of the row's own stamp unless one is given for all. ``current_hash`` becomes the
    hash of the bytes copied, which is what the state must say if a file was changed after it had been
    hashed. Cut the stage before: the rows are read twice, and only stamped ones go to Python.
    """

    def transform(df: DataFrame) -> DataFrame:
        marked = has_component("backup_date")
        folder = version_stamp(F.col("backup_date.backup_date")) if version is None else version
        target = target_path(destination, folder, relative_path(F.col(PATH), source))
        rows = spread(df.where(marked), PATH, tasks).withColumn("_copy", copy_files(PATH, target, staging))
        stored = F.col("file_hash").withField("current_hash", F.col("_copy.sha256"))
        status = first_failure(
            require(has_component("file_path"), PATH_MISSING),
            require(F.col("_copy.error").isNull(), F.concat(F.lit(STORE_FAILED), F.col("_copy.error"))),
        )
        rows = set_component(rows, "file_hash", stored, where=F.col("_copy.sha256").isNotNull())
        rows = rows.withColumn(RESULT, status).drop("_copy")
        return rows.unionByName(df.where(~marked).withColumn(RESULT, ok()))

    return transform


def put_back(folder: str, target: str, staging: str, tasks: int | None = None) -> Transform:
    """Copy the files of a version folder to the same relative paths below ``target``."""

    def transform(df: DataFrame) -> DataFrame:
        relative = relative_path(F.col(PATH), folder)
        is_file = relative != "."
        goal = F.concat_ws("/", F.lit(target), relative)
        copy = copy_files(F.when(is_file, F.col(PATH)), F.when(is_file, goal), staging)
        problem = F.col("_copy.error")
        status = require(problem.isNull(), F.concat(F.lit(RESTORE_FAILED), problem))
        return spread(df, PATH, tasks).withColumn("_copy", copy).withColumn(RESULT, status).drop("_copy")

    return transform


def _seed(spark: SparkSession, path: str) -> DataFrame:
    seed = spark.createDataFrame([(path,)], "path string")
    return seed.select(entity_id(F.lit("seed"), "path").alias("entity_id"), _path_component())


def _path_component() -> Column:
    return F.struct(F.col("path").alias("file_path")).alias("file_path")
