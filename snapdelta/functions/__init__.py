"""Column functions: hashes, paths, stamps and row status."""

from snapdelta.functions.hashing import content_hash, encode, entity_id, hash_of_columns
from snapdelta.functions.paths import parent_path, relative_path, target_path
from snapdelta.functions.stamps import display_date, timestamp_literal, version_stamp
from snapdelta.functions.status import fail, first_failure, ok, require

__all__ = [
    "content_hash",
    "display_date",
    "encode",
    "entity_id",
    "fail",
    "first_failure",
    "hash_of_columns",
    "ok",
    "parent_path",
    "relative_path",
    "require",
    "target_path",
    "timestamp_literal",
    "version_stamp",
]
