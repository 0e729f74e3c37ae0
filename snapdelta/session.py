"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from snapdelta.sources.folders import remove

_local_base: str | None = None


def build_session(master: str | None = None, app: str = "snapdelta", **conf: str) -> SparkSession:
    """A session with the settings this library relies on: AQE, UTC and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder set in ``spark.checkpoint.dir``.

    Written tables go there when lineage has to be cut. Only a local-mode session may fall back to a
    temporary folder; a cluster without the setting is an error, because one machine's disk is
    neither visible to the other executors nor safe from the loss of that machine.
    """
    return f"{_shared(spark)}/snapdelta/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A fresh folder under the shared one that goes when the work with it is done, or has failed."""
    path = scratch_dir(spark, purpose)
    try:
        yield path
    finally:
        remove(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as it is now, cut in the shared folder, with its partitions and the order in them kept."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_scratch()
    return base.rstrip("/")


def _local_scratch() -> str:
    global _local_base
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="snapdelta-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
    return _local_base
