"""Folder listings through Spark's Hadoop file system, so any scheme Spark can write to works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, sorted; none if it does not exist."""
    fs, where = _resolve(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path``, sorted; none if it does not exist."""
    fs, where = _resolve(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile())


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, which must not be there yet."""
    fs, where = _resolve(spark, path)
    fs.create(where, False).close()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    fs, where = _resolve(spark, path)
    return fs.exists(where)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to this folder ran to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def number(folder: str) -> int:
    """The serial number of a folder named ``<kind>=<number>``."""
    return int(folder.rpartition("=")[2])


def current(spark: SparkSession, path: str) -> list[str]:
    """Numbered folders that count: the last finished ``full=N``, if any, and what was finished since, oldest first."""
    found: list[str] = []
    for name in sorted(child_folders(spark, path), key=number, reverse=True):
        if committed(spark, f"{path}/{name}"):
            found.insert(0, name)
            if name.startswith("full="):
                break
    return found


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove numbered folders older than all that count, finished or not; returns their names.

    For a time when no job reads the store: a frame planned before may still name them.
    """
    kept = current(spark, path)
    old = [n for n in child_folders(spark, path) if kept and number(n) < number(kept[0])]
    for name in old:
        remove(spark, f"{path}/{name}")
    return old


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it; nothing happens if there is none."""
    fs, where = _resolve(spark, path)
    fs.delete(where, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, where = _resolve(spark, path)
    return fs.getContentSummary(where).getLength()


def remove_file(spark: SparkSession, uri: str) -> None:
    """Remove a file by the name Spark gives it, a URI; nothing happens if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def move_files(spark: SparkSession, source: str, target: str) -> None:
    """Move the data files below a folder, at any depth, to the same relative places below another."""
    fs, where = _resolve(spark, source)
    if not fs.exists(where):
        return
    root, found, names = fs.makeQualified(where).toUri().getPath(), fs.listFiles(where, True), []
    while found.hasNext():
        names.append(found.next().getPath().toUri().getPath().removeprefix(f"{root}/"))
    for name in names:
        if not name.rpartition("/")[2].startswith(("_", ".")):
            goal = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
            fs.mkdirs(goal.getParent())
            if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}"), goal):
                raise OSError(f"{name} was not moved to {target}")


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a small file of lines, which shows under its name only when it is whole."""
    fs, where = _resolve(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write("".join(f"{line}\n" for line in lines).encode())
    finally:
        stream.close()
    if not fs.rename(part, where):
        raise OSError(f"{path} was not written")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file."""
    fs, where = _resolve(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().splitlines()
    finally:
        stream.close()


def _resolve(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
