"""Row status: success without a message, or failure with one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "_result"
RESULT_TYPE = "struct<is_success:boolean,error_message:string>"

# The messages of the built-in stages.
COMPONENT_MISSING = "Component missing."
PATH_MISSING = "FilePathComponent missing."
HASH_FAILED = "Failed to compute hash."
REQUIRED_MISSING = "Required components missing."
STORE_FAILED = "Failed to store file version: "
RESTORE_FAILED = "Failed to restore files: "
VERSION_NOT_FOUND = "Backup date not found."
NO_VERSIONS = "No backup dates found."


def ok() -> Column:
    """Success; its message is NULL."""
    return _status(F.lit(True), F.lit(None))


def fail(message: Column | str | None) -> Column:
    """Failure with a message, which may be NULL."""
    return _status(F.lit(False), message if isinstance(message, Column) else F.lit(message))


def require(condition: Column, message: Column | str | None) -> Column:
    """Success where the condition holds; failure where it is false or NULL."""
    return F.when(condition, ok()).otherwise(fail(message))


def first_failure(*statuses: Column) -> Column:
    """The first failing status in the order given, else success."""
    chain = F.when(F.lit(False), ok())
    for status in statuses:
        chain = chain.when(~status["is_success"], status)
    return chain.otherwise(ok())


def _status(success: Column, message: Column) -> Column:
    return F.struct(success.alias("is_success"), message.cast("string").alias("error_message"))
