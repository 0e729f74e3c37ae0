"""Path arithmetic on ``/``-separated paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, root: Column | str) -> Column:
    """``path`` as seen from ``root``: ``.`` for the root itself, ``..`` steps when it lies outside."""
    root = F.lit(root.rstrip("/")) if isinstance(root, str) else F.rtrim(root, F.lit("/"))
    below = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(below, F.substr(path, F.char_length(root) + 2)).otherwise(_climb(path, root))


def _climb(path: Column, root: Column) -> Column:
    here, there = F.split(root, "/"), F.split(path, "/")
    depth = F.least(F.size(here), F.size(there))
    # The first segment is always shared: it is the empty string before the leading slash.
    shared = F.size(
        F.filter(F.sequence(F.lit(1), depth), lambda n: F.slice(here, 1, n) == F.slice(there, 1, n))
    )
    steps = F.concat(
        F.array_repeat(F.lit(".."), F.size(here) - shared),
        F.slice(there, shared + 1, F.size(there)),
    )
    return F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/"))


def target_path(destination: Column | str, version: Column, relative: Column) -> Column:
    """``<destination>/<version>/<relative path>``."""
    if isinstance(destination, str):
        destination = F.lit(destination.rstrip("/"))
    return F.concat_ws("/", destination, version, relative)


def parent_path(path: Column) -> Column:
    """The folder part of a path; empty when there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
