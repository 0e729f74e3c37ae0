"""JSON import and export of the hash state and the version log.

The formats are one JSON object of key to hash and one JSON array of ISO dates. What is too large for
one document is exported as many, one per line, which read back in parallel. Import finds out by itself: a
folder that Spark has written holds a document per line, anything else is one document per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.operators.components import latest
from snapdelta.sources.folders import committed, exists
from snapdelta.sources.log import LOG_SCHEMA

STATE_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("content_hash", T.StringType())])
ENTRIES_PER_DOCUMENT = 50_000


def import_state(spark: SparkSession, path: str, one_document: bool | None = None) -> DataFrame:
    """Hash state from JSON; of a key given twice in a document, the last value, and between documents the
    one further down in its own, then the greater one.

    An absent file and a JSON ``null`` are empty. Malformed JSON, a blank document and text after its end fail.

    One document is read by one task and must fit a string, so below 2 GB. A document per line has no such
    limit; ``one_document`` says which it is where that cannot be seen from the folder.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA)
    parsed = _parsed(T.MapType(T.StringType(), T.StringType()))
    entries = _documents(spark, path, one_document).select(F.posexplode(parsed).alias("_at", "key", "content_hash"))
    return latest(entries.withColumn("_tie", F.col("content_hash")), ["key"], ["_at", "_tie"], ["content_hash"])


def export_state(state: DataFrame, path: str, entries_per_document: int = ENTRIES_PER_DOCUMENT) -> None:
    """Write ``key, content_hash`` rows as JSON objects, one per line.

    A state that fits one object gives the one-document form.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("key", "content_hash")))
    _write_slices(state, "key", F.to_json(entries), path, entries_per_document)


def import_log(spark: SparkSession, path: str, one_document: bool | None = None) -> DataFrame:
    """Version dates from a JSON array, or from an array per line; empty and malformed files as for the state."""
    if not exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    parsed = _parsed(T.ArrayType(T.StringType()))
    dates = _documents(spark, path, one_document).select(F.explode(parsed).alias("text"))
    return dates.select(F.col("text").cast("timestamp").alias("backup_date")).distinct()


def export_log(log: DataFrame, path: str, entries_per_document: int = ENTRIES_PER_DOCUMENT) -> None:
    """Write the version dates as JSON arrays of ISO dates in UTC, one array per line."""
    iso = F.date_format("backup_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso")
    arrays = F.to_json(F.sort_array(F.collect_list("iso")))
    _write_slices(log.select(iso).distinct(), "iso", arrays, path, entries_per_document)


def _write_slices(rows: DataFrame, key: str, document: Column, path: str, entries: int) -> None:
    """Spread rows by the hash of their key over as many documents as keep each near the set size."""
    slices = max(-(-rows.count() // entries), 1)
    sliced = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(slices)).alias("slice"))
    sliced.agg(document.alias("value")).select("value").write.text(path)


def _parsed(schema: T.DataType) -> Column:
    """The document in ``value``; fails on malformed JSON, which the default mode would pass over as NULL.

    The parser stops where a document ends. Inside an object of two fields it has to go on to the second.
    """
    whole = T.StructType([T.StructField("document", schema), T.StructField("snapdelta_end", T.BooleanType())])
    value = F.concat(F.lit('{"document":'), F.col("value"), F.lit(',"snapdelta_end":true}'))
    read = F.from_json(value, whole, {"mode": "FAILFAST"})
    ended = F.when(read.snapdelta_end, read.document)
    blank = F.rlike("value", F.lit(r"^\s*$")) | read.snapdelta_end.isNull()
    return F.when(blank, F.raise_error(F.lit("a JSON document is blank or does not end where its text does"))).otherwise(ended)


def _documents(spark: SparkSession, path: str, one_document: bool | None) -> DataFrame:
    whole = not committed(spark, path) if one_document is None else one_document
    documents = spark.read.text(path, wholetext=whole)
    # A file without a byte gives no row, so that a document cut off at its start would pass for an empty one.
    if whole and documents.isEmpty():
        raise ValueError(f"a JSON document is blank: {path}")
    return documents
