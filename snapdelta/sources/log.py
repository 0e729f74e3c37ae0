"""The version log: the dates at which versions were made.

An addition writes its dates as a new ``entry=N`` folder. Reading puts together the entries since the last ``full=N`` folder, and
that one; after ``COMPACT_AFTER`` entries the next addition writes a full one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from snapdelta.operators.versions import log_add
from snapdelta.sources.folders import child_folders, number
from snapdelta.sources.folders import current as _current

COMPACT_AFTER = 32
LOG_SCHEMA = T.StructType([T.StructField("backup_date", T.TimestampType())])


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """All dates, once each; an empty frame if the log does not exist."""
    folders = [f"{path}/{name}" for name in _current(spark, path)]
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders).distinct()


def append_log(spark: SparkSession, path: str, dates: DataFrame) -> str:
    """Add dates; those already there collapse. Returns the folder written."""
    serial = max([number(n) for n in child_folders(spark, path)], default=0) + 1
    rows, kind = dates.select("backup_date").distinct(), "entry"
    if len(_current(spark, path)) > COMPACT_AFTER:
        rows, kind = log_add(load_log(spark, path), dates), "full"
    folder = f"{path}/{kind}={serial:08d}"
    rows.write.parquet(folder)
    return folder
