"""Differential backup, version listing and restore of keyed tables.

The store has three folders: ``versions`` (the rows of each version), ``log`` (version dates) and ``state``
(key to hash). They are written in this order. The state comes last: until it is there, the next run takes
the rows as not stored and copies them again, so a crash never hides a version.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.hashing import entity_id, hash_of_columns
from snapdelta.functions.names import quoted
from snapdelta.functions.stamps import stamp_of, timestamp_literal, version_stamp
from snapdelta.functions.status import (
    HASH_FAILED,
    NO_VERSIONS,
    PATH_MISSING,
    RESULT,
    VERSION_NOT_FOUND,
    first_failure,
    require,
)
from snapdelta.operators.components import has_component, seed_entities, set_component
from snapdelta.operators.delta import with_prior
from snapdelta.plans import steps
from snapdelta.plans.stages import Pipeline, Stage, Transform
from snapdelta.plans.steps import component_types, decide, gather, newest_version
from snapdelta.session import scratch_folder
from snapdelta.sources import folders
from snapdelta.sources.log import append_log
from snapdelta.sources.snapshots import HASH_IN_VERSION, TAKEN, read_batch, read_version, write_version, write_versions
from snapdelta.sources.state import open_state, save_state

# Changed rows are written in slices of about so many keys, the most that is broadcast for one of them, from so many files.
SLICE_KEYS = 1_000_000
SLICE_FILES = 1_000
# So many slices go into one job, whose tasks run side by side.
AT_ONCE = 4
# So few changed rows are put into few files, by a shuffle of these rows alone. More are written where they are read.
GATHERED = 10_000
FILE, STAMP = "_snapdelta_file", "_snapdelta_stamp"
# Hidden folders below the target of a restore.
STAGED = "_snapdelta_restore-"


@dataclass(frozen=True)
class Restored:
    """Rows of a version, or None with the reason in ``error``.

    ``entities`` is the entity table of the run: the store as seed entity, with the reason as its ``error`` component.
    """

    rows: DataFrame | None
    error: str | None = None
    entities: DataFrame | None = None


def backup_table(
    spark: SparkSession,
    current: DataFrame,
    key: Sequence[str],
    content: Sequence[str],
    store: str,
    run_ts: dt.datetime | None = None,
    stamp_col: str | None = None,
) -> DataFrame:
    """Write the rows that are new or changed since the last run as a new version.

    ``key`` is unique in ``current`` (use ``last_wins`` first where it is not), and ``current`` gives the
    same rows whenever it is read. Returns the entity table of the run: key, ``file_hash``, ``backup_date``
    on the rows chosen and ``error`` on rows that failed. It is lazy and compares with the state before the
    run; write it down if it is to outlive the source.

    All rows get the time of the run, ``run_ts``, as their stamp, or with ``stamp_col`` the time in that column (where it is NULL, that
    of the run). Rows go into the version of their stamp; one run may so write many versions, which are all committed at once.

    The first run hashes and writes in a single pass. Later ones read the content once to hash it and, if
    anything changed, read what is needed to write it: where ``current`` comes straight from files, only
    the files with changes, in slices whose keys are broadcast, so that content is never shuffled. Only keys
    and hashes are joined with the state. Column names that begin with ``_snapdelta_`` are reserved.
    """
    taken = [name for name in current.columns if name.lower().startswith(TAKEN)]
    if taken:
        raise ValueError(f"reserved column names in the source: {', '.join(taken)}")
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc)
    fields = [current.schema[name] for name in key]
    state = open_state(spark, f"{store}/state", fields)
    report = detect(current, key, content, state, run_ts, stamp_col)

    rows = current.withColumn(HASH_IN_VERSION, hash_of_columns(current, content))
    root = f"{store}/versions"
    with scratch_folder(spark, "marked") as marks:
        if state:
            slices = _changed_rows(rows, current, key, content, state, run_ts, marks)
        else:
            # Not a test of the hash itself, which would be computed for the test and for the row.
            rows = rows.where(has_component(*key, *(content if len(content) == 1 else ())))
            slices = [] if rows.isEmpty() else [rows]
        if not slices:
            return report
        if stamp_col:
            moment = _moment(F.col(quoted(stamp_col)), run_ts)
            slices = [rows.withColumn(STAMP, moment) for rows in slices]
            batch = write_versions(spark, root, version_stamp(F.col(STAMP)), *slices)
            dates = read_batch(spark, root, batch, T.StructType([T.StructField(STAMP, T.TimestampType())])).distinct()
        else:
            batch = write_version(spark, root, stamp_of(run_ts), *slices)
            dates = spark.range(0, 1, 1, 1).select(timestamp_literal(run_ts).alias(STAMP))
    written = read_batch(spark, root, batch, T.StructType([*fields, T.StructField(HASH_IN_VERSION, T.StringType())]))
    append_log(spark, f"{store}/log", dates.withColumnRenamed(STAMP, "backup_date"))
    save_state(spark, f"{store}/state", written.withColumnRenamed(HASH_IN_VERSION, "content_hash"), fields)
    return report


def detect(
    current: DataFrame,
    key: Sequence[str],
    content: Sequence[str],
    state: DataFrame | Sequence[DataFrame],
    run_ts: dt.datetime,
    stamp_col: str | None = None,
) -> DataFrame:
    """The entity table of a run: which rows are new or changed, and which failed."""
    stamps = [_moment(F.col(quoted(stamp_col)), run_ts).alias(STAMP)] if stamp_col else []
    hashed = current.select(*key, *stamps, hash_of_columns(current, content).alias("current_hash"))
    return _detected(hashed, key, state, run_ts).drop(STAMP)


def _detected(hashed: DataFrame, key: Sequence[str], state: DataFrame | Sequence[DataFrame], run_ts: dt.datetime) -> DataFrame:
    own = STAMP if STAMP in hashed.columns else None
    stages = [
        Stage(steps.HASHING, [look_up(state, key)], components=component_types("file_hash")),
        Stage(steps.DECISION, [decide(("file_hash",), run_ts, own)], components=component_types("backup_date")),
    ]
    return Pipeline(stages, key=key).run(hashed, distinct_input=True)


def _moment(stamp: Column, run_ts: dt.datetime) -> Column:
    return F.coalesce(stamp.cast("timestamp"), timestamp_literal(run_ts))


def restore_table(spark: SparkSession, store: str, version: str | dt.datetime, key: Sequence[str]) -> Restored:
    """The rows that changed in one version; no other version is read."""
    version = version if isinstance(version, str) else stamp_of(version)
    rows = read_version(spark, f"{store}/versions", version, key)
    return _restored(spark, f"{store}/versions/{version}", rows, None if rows is not None else VERSION_NOT_FOUND)


def restore_latest_table(spark: SparkSession, store: str, key: Sequence[str]) -> Restored:
    """The rows of the newest version in the log."""
    version = newest_version(spark, store)
    return restore_table(spark, store, version, key) if version else _restored(spark, f"{store}/versions", None, NO_VERSIONS)


def _restored(spark: SparkSession, path: str, rows: DataFrame | None, error: str | None) -> Restored:
    seed = spark.createDataFrame([(path,)], "path string")
    seed = seed_entities(seed, F.col("path"), entity_id(F.lit("seed"), "_path"))
    check = Stage(steps.RESTORE, [lambda df: df.withColumn(RESULT, require(F.lit(error is None), error))])
    return Restored(rows, error, Pipeline([check]).run(seed, distinct_input=True))


def put_over(target: DataFrame, restored: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` with restored rows in place of its rows of the same key; other rows stay.

    One anti join: Spark broadcasts the restored keys if they are few and else shuffles both sides by key. ``restore_into`` changes
    a stored target without reading all of it.
    """
    kept = target.join(restored.select(*key), list(key), "left_anti")
    return kept.unionByName(restored.select(*target.columns))


def restore_into(
    spark: SparkSession, target: str, restored: DataFrame, key: Sequence[str], partition_by: Sequence[str] = ()
) -> list[str]:
    """Write restored rows over the rows of the same key in a folder of Parquet; other rows stay. Returns the files replaced.

    Copy on write: only the files that hold restored keys are written anew, without those rows, and the restored rows are added as new
    files. Which files these are is found from key columns alone. They are read in slices whose keys are broadcast (``SLICE_KEYS``,
    ``SLICE_FILES``), so no content of the target is shuffled. New files are staged in a hidden folder; then a plan of the exchange is
    written, and it takes place file by file. A run that stops before it has the plan changes nothing; one that stops later is
    finished by the next call, or by ``finish_restore``. Readers should wait meanwhile. Keys are unique in ``restored``; a NULL key
    matches none. ``partition_by`` names the partition columns of the target.
    """
    finish_restore(spark, target)
    rows = spark.read.parquet(target)
    restored = restored.select(*[quoted(c) for c in rows.columns])
    file = F.col("_metadata.file_path")
    held = rows.select(*key, F.xxhash64(file).alias(FILE), file.alias("_name")).join(restored.select(*key), list(key), "left_semi")
    with scratch_folder(spark, "held") as marks:
        gather(held).write.parquet(marks)
        held = spark.read.schema(held.schema).parquet(marks)
        # As many rows as there are files to be replaced.
        touched = sorted(tuple(r) for r in held.groupBy("_name", FILE).agg(F.count(F.lit(1)).alias("n")).collect())

        slices = [_slice(rows, held, key, *part, how="left_anti") for part in _parts(touched)]
        together = [reduce(DataFrame.unionByName, slices[k : k + AT_ONCE]) for k in range(0, len(slices), AT_ONCE)]
        staged = f"{target}/{STAGED}{uuid.uuid4().hex}"
        for new in [*together, restored]:
            new.write.mode("append").partitionBy(*partition_by).parquet(f"{staged}/new")
    replaced = [name for name, _, _ in touched]
    folders.write_lines(spark, f"{staged}/plan", replaced)
    finish_restore(spark, target)
    return replaced


def finish_restore(spark: SparkSession, target: str) -> None:
    """Let staged files take the place of those they replace, as planned; staged files without a plan are removed.

    Each step may be done again: what has been moved is not there any more, nor is what has been removed.
    """
    for name in folders.child_folders(spark, target):
        if not name.startswith(STAGED):
            continue
        staged = f"{target}/{name}"
        if folders.exists(spark, f"{staged}/plan"):
            # Old files go first: a reader may miss rows for a moment, but never finds two of a key.
            for old in folders.read_lines(spark, f"{staged}/plan"):
                folders.remove_file(spark, old)
            folders.move_files(spark, f"{staged}/new", target)
        folders.remove(spark, staged)


def look_up(state: DataFrame | Sequence[DataFrame], key: Sequence[str]) -> Transform:
    """Set the ``file_hash`` component from the hash in the row and the stored one."""

    def transform(df: DataFrame) -> DataFrame:
        known = with_prior(df, state, key)
        keyed = has_component(*key)
        status = first_failure(
            require(keyed, PATH_MISSING), require(F.col("current_hash").isNotNull(), HASH_FAILED)
        )
        hashes = F.struct("current_hash", "previous_hash")
        known = set_component(known, "file_hash", hashes, where=keyed & F.col("current_hash").isNotNull())
        return known.withColumn(RESULT, status).drop("current_hash", "previous_hash")

    return transform


def _changed_rows(
    rows: DataFrame, current: DataFrame, key: Sequence[str], content: Sequence[str], state: Sequence[DataFrame], run_ts: dt.datetime,
    marks: str,
) -> list[DataFrame]:
    """The new and changed ones of ``rows``, in slices, several of them in one frame; none if there are none.

    The keys become a table of their own, in the folder ``marks``, with a mark of the file each was read from; the names of the files are gathered
    while the rows are hashed. A slice is some files with changes and their keys; a file with more keys than a slice holds is read for
    each part of them. A source that is not files is read once, with one semi join.
    """
    seen, hashes = Observation(), hash_of_columns(current, content).alias("current_hash")
    rows_seen = F.count(F.lit(1)).alias("n")
    if _from_files(current):
        name = F.col("_metadata.file_path")
        hashed = current.select(*key, F.xxhash64(name).alias(FILE), name.alias("_name"), hashes)
        # As many names as there are files, whose list the driver holds anyway.
        hashed = hashed.observe(seen, rows_seen, F.collect_set(F.struct(FILE, "_name")).alias("files")).drop("_name")
    else:
        hashed = current.select(*key, hashes).observe(seen, rows_seen)
    marked = _detected(hashed, key, state, run_ts).where(has_component("backup_date"))
    marked = marked.select(*key, *[name for name in hashed.columns if name == FILE])
    gather(marked).write.parquet(marks)
    marked = rows.sparkSession.read.schema(marked.schema).parquet(marks)
    by_file = [FILE] if FILE in marked.columns else []
    counts = {r[0]: r[-1] for r in marked.groupBy(*by_file).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_marked = sum(counts.values())
    if not n_marked:
        return []
    # A repeated task may count rows twice, but never too few: equal numbers do mean all rows.
    if n_marked == seen.get["n"]:
        return [rows]
    if by_file:
        touched = sorted((name, mark, counts[mark]) for mark, name in {tuple(f) for f in seen.get["files"]} if mark in counts)
        slices = [_slice(rows, marked, key, *part) for part in _parts(touched)]
        together = [reduce(DataFrame.unionByName, slices[k : k + AT_ONCE]) for k in range(0, len(slices), AT_ONCE)]
    else:
        together = [rows.join(marked.select(*key), list(key), "left_semi")]
    return [gather(rows) for rows in together] if n_marked <= GATHERED else together


def _parts(touched: list[tuple[str, int, int]]) -> list[tuple[list[str], list[int], int, int]]:
    """Files, their marks, and which part of how many of their keys, for every slice."""
    parts: list[tuple[list[str], list[int], int, int]] = []
    names, marks, keys = [], [], 0
    for name, mark, n in touched:
        if n > SLICE_KEYS:
            whole = -(-n // SLICE_KEYS)
            parts += [([name], [mark], i, whole) for i in range(whole)]
            continue
        if keys + n > SLICE_KEYS or len(names) == SLICE_FILES:
            parts.append((names, marks, 0, 1))
            names, marks, keys = [], [], 0
        names.append(name)
        marks.append(mark)
        keys += n
    return [*parts, (names, marks, 0, 1)] if names else parts


def _slice(
    rows: DataFrame, marked: DataFrame, key: Sequence[str], names: list[str], marks: list[int], part: int, whole: int, how: str = "left_semi"
) -> DataFrame:
    """The rows of some files, or of a part of one, whose keys are marked, or with ``left_anti`` those whose keys are not."""
    mine = F.pmod(F.xxhash64(*key), F.lit(whole)) == part if whole > 1 else F.lit(True)
    keys = marked.where(F.col(FILE).isin(marks) & mine).select(*key)
    # At most SLICE_KEYS keys.
    return rows.where(F.col("_metadata.file_path").isin(names) & mine).join(F.broadcast(keys), list(key), how)


def _from_files(df: DataFrame) -> bool:
    """Whether rows come straight from files, so that Spark can say from which."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    return any(hidden.apply(i).name() == "_metadata" for i in range(hidden.size())) and "_metadata" not in df.columns
