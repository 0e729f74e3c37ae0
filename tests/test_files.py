from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import relative_path
from snapdelta.sources import files
from snapdelta.sources.files import (
    copy_files,
    file_sha256,
    inventory,
    list_files,
    posix,
    remove_staging,
    remove_tree,
    write_texts,
)

TREE = {
    "file1.txt": b"one",
    ".hidden": b"two",
    "_under": b"three",
    "empty": b"",
    "a/name with space": b"four",
    "a/100%.txt": b"five",
    "a/.dir/deep/ü.bin": bytes(range(256)) * 100,
}


def grow(root: Path, tree: dict[str, bytes]) -> Path:
    for name, content in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def contents(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_listing_finds_every_file_at_every_depth(spark, tmp_path):
    grow(tmp_path, TREE)
    found = list_files(spark, f"{tmp_path}/").collect()
    assert {os.path.relpath(r["path"], tmp_path): r["size"] for r in found} == {n: len(c) for n, c in TREE.items()}
    assert len(found) == len(TREE)


def test_listing_reports_modification_times(spark, tmp_path):
    grow(tmp_path, {"a": b"x"})
    os.utime(tmp_path / "a", (1_700_000_000, 1_700_000_000))
    assert list_files(spark, str(tmp_path)).select(F.unix_seconds("modified")).first()[0] == 1_700_000_000


def test_paths_may_be_file_uris(spark, tmp_path):
    grow(tmp_path, {"a": b"x"})
    assert posix(f"file://{tmp_path}/") == posix(f"file:{tmp_path}") == posix(str(tmp_path)) == str(tmp_path)
    assert list_files(spark, f"file://{tmp_path}").select("path").first()[0] == f"{tmp_path}/a"
    with pytest.raises(ValueError, match="POSIX"):
        list_files(spark, "hdfs://host/folder")


def test_empty_folders_give_no_rows(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert list_files(spark, str(tmp_path)).isEmpty()


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        list_files(spark, f"{tmp_path}/none")


def test_inventory_agrees_with_hashlib(spark, tmp_path):
    grow(tmp_path, TREE)
    found = inventory(spark, str(tmp_path)).select(relative_path(F.col("path"), str(tmp_path)), "sha256").collect()
    assert dict(map(tuple, found)) == {n: hashlib.sha256(c).hexdigest() for n, c in TREE.items()}


def test_many_files_in_one_folder(spark, tmp_path):
    grow(tmp_path, {f"hot/{n}": b"" for n in range(1500)} | {"cold/1": b""})
    assert list_files(spark, str(tmp_path)).count() == 1501


def test_dangling_link_is_listed_and_has_no_hash(spark, tmp_path):
    (tmp_path / "link").symlink_to(tmp_path / "nowhere")
    assert [r["sha256"] for r in inventory(spark, str(tmp_path)).collect()] == [None]


def test_hash_of_missing_path_null_and_folder_is_null(spark, tmp_path):
    frame = spark.createDataFrame([(f"{tmp_path}/none",), (None,), (str(tmp_path),)], "path string")
    assert [r[0] for r in frame.select(file_sha256("path")).collect()] == [None, None, None]


def test_copy_makes_folders_overwrites_and_reports(spark, tmp_path):
    grow(tmp_path, {"in/a": b"new", "in/b": b"b", "out/a": b"old", "out/other": b"kept", "out/file": b""})
    pairs = [("in/a", "out/a"), ("in/b", "out/x/y/b"), ("in/none", "out/none"), ("in/b", "out/file/b")]
    frame = spark.createDataFrame([(f"{tmp_path}/{s}", f"{tmp_path}/{t}") for s, t in pairs], "s string, t string")
    done = frame.select("t", copy_files("s", "t", f"{tmp_path}/.staging").alias("c")).collect()
    result = {os.path.relpath(r["t"], tmp_path): (r["c"]["sha256"], r["c"]["error"]) for r in done}
    assert result["out/a"] == (hashlib.sha256(b"new").hexdigest(), None)
    assert result["out/none"][0] is None and "No such file" in result["out/none"][1]
    assert result["out/file/b"][0] is None and result["out/file/b"][1]
    assert contents(tmp_path / "out") == {"a": b"new", "x/y/b": b"b", "other": b"kept", "file": b""}
    assert list((tmp_path / ".staging").iterdir()) == []
    remove_staging(f"{tmp_path}/.staging")
    assert not (tmp_path / ".staging").exists()


def test_copy_of_null_does_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(None, f"{tmp_path}/x"), (f"{tmp_path}/x", None)], "s string, t string")
    copies = frame.select(copy_files("s", "t", f"{tmp_path}/.staging").alias("c")).select("c.*").collect()
    assert [tuple(r) for r in copies] == [(None, None), (None, None)]


def test_copy_larger_than_one_chunk(spark, tmp_path):
    big = os.urandom(1024) * (9 * 1024)
    grow(tmp_path, {"big": big})
    frame = spark.createDataFrame([(f"{tmp_path}/big", f"{tmp_path}/copy")], "s string, t string")
    assert frame.select(copy_files("s", "t", f"{tmp_path}/.staging")["sha256"]).first()[0] == hashlib.sha256(big).hexdigest()
    assert (tmp_path / "copy").read_bytes() == big


def test_write_texts(spark, tmp_path):
    frame = spark.createDataFrame([("a/b.txt", "zwei\r\nü"), ("c", "")], "p string, t string")
    assert [r["error"] for r in write_texts(frame, f"{tmp_path}/out/", "p", "t", f"{tmp_path}/staging").collect()] == [None, None]
    assert contents(tmp_path / "out") == {"a/b.txt": "zwei\r\nü".encode(), "c": b""}


def test_odd_names_and_link_loops_end_in_rows(spark, tmp_path):
    root = tmp_path / "odd"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "one.txt").write_text("1")
    with open(os.fsencode(str(root)) + b"/bad\xff\xfename", "wb") as f:
        f.write(b"2")
    (root / "a" / "b" / "up").symlink_to(root)
    rows = {r.path: r.sha256 for r in files.inventory(spark, str(root)).collect()}
    assert len(rows) == 3
    odd = next(p for p in rows if p.endswith("name"))
    assert os.fsencode(files.real(odd)).endswith(b"bad\xff\xfename")
    assert rows[odd] == hashlib.sha256(b"2").hexdigest()
    assert rows[f"{root}/a/one.txt"] == hashlib.sha256(b"1").hexdigest()
    assert rows[f"{root}/a/b/up"] is None


def test_tasks_follow_files_and_bytes_without_a_cap(spark):
    assert files.task_count(spark, 10**9) > 200_000
    assert files.task_count(spark, 1000, 10**15) > 200_000
    assert files.task_count(spark, 0) >= 1


def test_rows_without_a_path_are_dealt_out(spark):
    rows = spark.range(4000).selectExpr("id", "cast(null as string) AS path")
    sizes = [r["count"] for r in files.spread(rows, "path", 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 800


def test_names_with_the_stand_ins_of_odd_bytes_are_found_again(spark, tmp_path):
    root = tmp_path / "own"
    root.mkdir()
    names = [b"a\xff", "b\U0010ffff".encode(), "c\U0010ff7f\U0010ff80".encode() + b"\x80", "\U0010ff7f".encode(), b"plain"]
    for name in names:
        with open(os.fsencode(str(root)) + b"/" + name, "wb") as f:
            f.write(name)
    rows = {r.path: r.sha256 for r in files.inventory(spark, str(root)).collect()}
    assert {os.fsencode(files.real(p)).rpartition(b"/")[2]: h for p, h in rows.items()} == {n: hashlib.sha256(n).hexdigest() for n in names}
    for path in (os.fsdecode(n) for n in names):
        assert files.real(files.shown(path)) == path
        files.shown(path).encode()


def test_staging_goes_with_what_killed_tasks_left(tmp_path):
    (tmp_path / ".staging").mkdir()
    (tmp_path / ".staging" / "half").write_bytes(b"x")
    files.remove_staging(f"{tmp_path}/.staging")
    assert not (tmp_path / ".staging").exists()


def test_a_tree_is_removed_with_odd_names_and_links(spark, tmp_path):
    root = grow(tmp_path / "tree", TREE)
    grow(tmp_path, {"kept/file": b"1"})
    with open(os.fsencode(str(root)) + b"/a/bad\xff", "wb") as f:
        f.write(b"2")
    (root / "a" / "folder").symlink_to(tmp_path / "kept")
    (root / "dangling").symlink_to(tmp_path / "nowhere")
    remove_tree(spark, str(root))
    assert not root.exists() and contents(tmp_path) == {"kept/file": b"1"}


def written_over(spark, path, *texts):
    frame = spark.createDataFrame([(path.name, t) for t in texts], "p string, t string").coalesce(1)
    assert [r["error"] for r in write_texts(frame, str(path.parent), "p", "t", f"{path.parent}.staging").collect()] == [None] * len(texts)
    return path.read_text()


def test_texts_are_written_over_in_place(spark, tmp_path):
    path = grow(tmp_path / "t", {"a": b"a longer text"}) / "a"
    before = path.stat().st_ino
    assert written_over(spark, path, "longer still than that", "short") == "short"
    assert path.stat().st_ino == before


def test_texts_are_not_written_through_links(spark, tmp_path):
    root = grow(tmp_path / "t", {"other": b"1", "shared": b"2", "fifo/x": b"3"})
    (root / "soft").symlink_to(root / "other")
    os.link(root / "shared", root / "hard")
    os.mkfifo(root / "pipe")
    for name in ("soft", "hard", "pipe"):
        assert written_over(spark, root / name, "new") == "new"
    assert contents(root) == {"other": b"1", "shared": b"2", "fifo/x": b"3", "soft": b"new", "hard": b"new", "pipe": b"new"}
    assert not (root / "soft").is_symlink()


def test_each_task_has_a_staging_folder_of_its_own(tmp_path):
    names = []
    for _ in range(2):
        with files._own_folder(str(tmp_path / ".staging")) as own:
            names.append(own)
            assert files._copy(str(grow(tmp_path, {"in": b"1"}) / "in"), str(tmp_path / "out"), own)[1] is None
            assert os.path.isdir(own) and os.path.dirname(own) == str(tmp_path / ".staging")
    assert names[0] != names[1] and os.listdir(tmp_path / ".staging") == []
    assert contents(tmp_path) == {"in": b"1", "out": b"1"}
