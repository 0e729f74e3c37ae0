"""File trees: listing, hashing and copying on the executors.

Paths are POSIX paths on a file system that every executor sees (NFS, a parallel file system, a
mounted bucket). Contents are streamed from file to hash or from file to file within a task and never
become column values, so the size of a file does not matter.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import fcntl
import hashlib
import io
import os
import re
import shutil
import stat
import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.session import scratch_dir

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("is_folder", T.BooleanType()),
    ]
)
# The helpers below travel with the tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 10_000
FILES_PER_TASK = 64
MOST_FILES = 4096
MOST_BYTES = 4 * 1024**3
CHUNK = 4 * 1024 * 1024
FIRST_CHUNK = 64 * 1024
REMOVED_AT_ONCE = 8


def posix(path: str) -> str:
    """A path for file work, without a slash at its end: a plain one, or one given as ``file:`` URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        raise ValueError(f"file trees need a POSIX path that all executors see, not {path}")
    return path.rstrip("/") or "/"


def list_files(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Every file below ``root`` at any depth, hidden and empty ones included.

    Folders are listed level by level, each level as one Spark job over all its folders, so a deep
    or lopsided tree is spread over the cluster. A linked folder is not descended into, which could go round for ever: it and a
    folder that cannot be opened are listed as entries that cannot be read. A name that is not
    UTF-8 is shown with each odd byte as a private-use character (``shown``) and found again by it. The listing is written to the scratch folder and
    read from there: all later steps see the same set of files. A missing root is an error.
    """
    root = posix(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    listing = scratch_dir(spark, "listing")
    folders, count, depth = spark.createDataFrame([(root,)], "path string"), 1, 0
    while count:
        # An explicit number: AQE would merge these few bytes of paths into a single task.
        level = folders.select("path").repartition(tasks or min(count, task_count(spark, count)), "path")
        folder = f"{listing}/depth={depth}"
        level.mapInPandas(_list_folders, ENTRY_SCHEMA).write.parquet(folder)
        folders = spark.read.schema(ENTRY_SCHEMA).parquet(folder).where("is_folder")
        count, depth = folders.count(), depth + 1
    found = spark.read.schema(ENTRY_SCHEMA).parquet(listing)
    return found.where(~F.col("is_folder")).select("path", "size", "modified")


def inventory(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """``list_files`` with the SHA-256 of each file; NULL where a file cannot be read."""
    listed = list_files(spark, root, tasks)
    return spread(listed, "path", tasks).withColumn("sha256", file_sha256("path"))


def spread(df: DataFrame, path: Column | str, tasks: int | None = None) -> DataFrame:
    """Spread rows that each stand for file work evenly over tasks; rows without a path are dealt out too.

    Unless ``tasks`` is given, the rows and, where there is a ``size``, their bytes are counted to choose it.
    """
    if tasks is None:
        size = F.sum("size") if "size" in df.columns else F.lit(0)
        n_files, n_bytes = df.agg(F.count(F.lit(1)), size).first()
        tasks = task_count(df.sparkSession, n_files, n_bytes or 0)
    path = F.col(path) if isinstance(path, str) else path
    return df.repartition(tasks, F.coalesce(path, F.xxhash64(*df.columns).cast("string")))


def task_count(spark: SparkSession, n_files: int, n_bytes: int = 0) -> int:
    """Tasks for file work: some per core while files are few, and as many more as files and bytes ask for.

    No task has more than about ``MOST_FILES`` files or, as far as sizes are known, ``MOST_BYTES``.
    """
    cores = spark.sparkContext.defaultParallelism
    some = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = min(some, max(cores, n_files // FILES_PER_TASK))
    return max(1, few, n_files // MOST_FILES, n_bytes // MOST_BYTES)


def file_sha256(path: Column | str) -> Column:
    """SHA-256 of the file at a path, as lower-case hex; NULL path or unreadable file gives NULL."""
    return _file_sha256(path)


@F.pandas_udf(T.StringType())
def _file_sha256(paths: pd.Series) -> pd.Series:
    return paths.map(_digest)


# Two reads of a file may differ, so Spark must not evaluate this twice for one row.
_file_sha256 = _file_sha256.asNondeterministic()


def copy_files(source: Column | str, target: Column | str, staging: str) -> Column:
    """Copy files on the executors: ``struct<sha256, error>`` with the hash of the bytes copied.

    Both NULL where the source or the target path is NULL. A copy is first written below the ``staging``
    folder, on the target's file system, and then renamed: a task that is run again replaces its own
    work, and no half file ever shows under a target path.
    """

    @F.pandas_udf("struct<sha256:string,error:string>")
    def copied(sources: pd.Series, targets: pd.Series) -> pd.DataFrame:
        with _own_folder(staging) as own:
            return pd.DataFrame([_copy(s, t, own) for s, t in zip(sources, targets)], columns=["sha256", "error"])

    return copied.asNondeterministic()(source, target)


def write_texts(rows: DataFrame, root: str, path: str, text: str, staging: str) -> DataFrame:
    """Write the text of each row to the file at its relative path below ``root``; lazy.

    Adds an ``error`` column, NULL where the file was written. Rows are written where they are, without
    a shuffle. A file that is there is written over in place.
    """
    root, staging = posix(root), posix(staging)

    @F.pandas_udf(T.StringType())
    def written(paths: pd.Series, texts: pd.Series) -> pd.Series:
        with _own_folder(staging) as own:
            return pd.Series([_write(f"{root}/{p}", t, own) for p, t in zip(paths, texts)], dtype="object")

    return rows.withColumn("error", written.asNondeterministic()(path, text))


def remove_staging(staging: str) -> None:
    """Remove a staging folder after a run, with the half files that killed tasks left there."""
    shutil.rmtree(staging, ignore_errors=True)


def remove_tree(spark: SparkSession, root: str, tasks: int | None = None) -> None:
    """Remove a file tree on the executors, its files first. What cannot be removed stays."""
    root = posix(root)
    listed = list_files(spark, root, tasks).select("path")
    spread(listed, "path", tasks).mapInPandas(_remove_files, listed.schema).count()
    shutil.rmtree(root, ignore_errors=True)


def _digest(path: str | None) -> str | None:
    if path is None:
        return None
    try:
        digest = hashlib.sha256()
        with open(real(path), "rb", buffering=0) as stream:
            for piece in _pieces(stream):
                digest.update(piece)
        return digest.hexdigest()
    except (OSError, TypeError, ValueError):
        return None


def _copy(source: str | None, target: str | None, staging: str) -> tuple[str | None, str | None]:
    if source is None or target is None:
        return None, None
    source, target = real(source), real(target)
    digest = hashlib.sha256()

    def fill(partial: str) -> None:
        with open(source, "rb", buffering=0) as reader, open(partial, "wb") as writer:
            for piece in _pieces(reader):
                digest.update(piece)
                writer.write(piece)
        shutil.copystat(source, partial)

    problem = _put(target, staging, fill)
    return (None, problem) if problem else (digest.hexdigest(), None)


def _write(target: str, text: str, staging: str) -> str | None:
    content = text.encode()

    def fill(partial: str) -> None:
        with open(partial, "wb") as writer:
            writer.write(content)

    return None if _rewritten(target, content) else _put(target, staging, fill)


def _rewritten(target: str, content: bytes) -> bool:
    """Write over a plain file that has no other name, if there is one: its blocks are kept, which is cheaper than to free and find them.

    Under a lock, for other tasks may have rows of the same path.
    """
    try:
        with open(os.open(target, os.O_WRONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC), "wb") as writer:
            info = os.fstat(writer.fileno())
            if not stat.S_ISREG(info.st_mode) or info.st_nlink != 1:
                return False
            fcntl.flock(writer, fcntl.LOCK_EX)
            writer.write(content)
            writer.truncate()
        return True
    except (OSError, ValueError):
        return False


def _pieces(stream: io.RawIOBase) -> Iterator[bytes]:
    """What a file holds: most files in one short piece, the rest of a longer one in large pieces."""
    size = FIRST_CHUNK
    while piece := stream.read(size):
        yield piece
        size = CHUNK


@contextlib.contextmanager
def _own_folder(staging: str) -> Iterator[str]:
    """A name for a staging folder of a task's own, gone afterwards unless half files are in it.

    In a folder that all tasks share, each would wait for the others to make and move its files.
    """
    own = os.path.join(staging, uuid.uuid4().hex)
    try:
        yield own
    finally:
        with contextlib.suppress(OSError):
            os.rmdir(own)


def _put(target: str, staging: str, fill: Callable[[str], None]) -> str | None:
    """Fill a file in the staging folder and move it to its place; the problem, if there is one."""
    partial = os.path.join(staging, uuid.uuid4().hex)
    try:
        _within(staging, lambda: fill(partial))
        _within(os.path.dirname(target), lambda: _replace(partial, target))
        return None
    except (OSError, ValueError) as problem:
        with contextlib.suppress(OSError):
            os.unlink(partial)
        return str(problem)


def _replace(partial: str, target: str) -> None:
    """Move a file to its place. The one that was there is let go afterwards: to free its blocks within the move would hold up all others."""
    held = None
    with contextlib.suppress(OSError):
        held = os.open(target, getattr(os, "O_PATH", os.O_RDONLY | os.O_NONBLOCK) | os.O_NOFOLLOW | os.O_CLOEXEC)
    try:
        os.replace(partial, target)
    finally:
        if held is not None:
            os.close(held)


def _within(folder: str, step: Callable[[], None]) -> None:
    """Do a step that needs a folder; the folder is made only if the step fails without it."""
    try:
        step()
    except (FileNotFoundError, NotADirectoryError):
        os.makedirs(folder, exist_ok=True)
        step()


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for folder in batch["path"]:
            try:
                entries = os.scandir(real(folder))
            except OSError:
                rows.append((folder, None, None, False))
                continue
            with entries:
                for entry in entries:
                    rows.append(_describe(entry))
                    if len(rows) == BATCH:
                        yield _frame(rows)
                        rows = []
    yield _frame(rows)


def _remove_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some files at once, since a file system may wait for the disk to take back the blocks of each."""

    def removed(paths: pd.Series) -> None:
        for path in paths:
            with contextlib.suppress(OSError):
                os.unlink(real(path))

    with ThreadPoolExecutor(REMOVED_AT_ONCE) as threads:
        for batch in batches:
            list(threads.map(removed, [batch["path"][k::REMOVED_AT_ONCE] for k in range(REMOVED_AT_ONCE)]))
            yield batch


# Bytes of a name that are not UTF-8, as Python gives them, show as the private-use characters from U+10FF80 on. A name that has
# such a character of its own, or the one before them, shows with that one before it.
_MARK = "\U0010ff7f"
_OWN = re.compile("[\U0010ff7f-\U0010ffff]")
_SHOWN = {0xDC00 + b: 0x10FF00 + b for b in range(0x80, 0x100)}


def shown(path: str) -> str:
    """A path as text that can be stored, whatever bytes it has."""
    if path.isascii():
        return path
    return _OWN.sub(lambda own: _MARK + own[0], path).translate(_SHOWN)


def real(path: str) -> str:
    """The path that ``shown`` has made storable."""
    if str.isascii(path):
        return path
    return re.sub(f"{_MARK}(.)|([\U0010ff80-\U0010ffff])", lambda c: c[1] or chr(ord(c[2]) - 0x10FF00 + 0xDC00), path, flags=re.DOTALL)


def _describe(entry: os.DirEntry) -> tuple:
    path = shown(entry.path)
    try:
        info = entry.stat()
        folder = entry.is_dir()
    except OSError:
        # For example a dangling link: still listed, and reported when it is read.
        return path, None, None, False
    if folder and entry.is_symlink():
        return path, None, None, False
    return path, info.st_size, dt.datetime.fromtimestamp(info.st_mtime, dt.timezone.utc), folder


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=ENTRY_SCHEMA.names)
    frame["modified"] = pd.to_datetime(frame["modified"], utc=True)
    return frame.astype({"size": "Int64", "is_folder": bool})
