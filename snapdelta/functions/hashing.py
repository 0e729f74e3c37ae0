"""Content hashes and entity ids, computed by Spark's own ``sha2``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(*cols: Column | str) -> Column:
    """SHA-256 as lower-case hex.

    One column is hashed as its raw bytes, and NULL stays NULL. Several columns are joined first in
    an unambiguous form, in which a NULL counts as a value of its own. Cast floating-point columns
    to DECIMAL beforehand, so that equal values print alike.
    """
    if not cols:
        raise ValueError("content_hash needs at least one column")
    if len(cols) == 1:
        return F.sha2(_column(cols[0]), 256)
    return F.sha2(encode(*cols), 256)


def hash_of_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """``content_hash`` of columns of any type: a sole text or bytes as they are, others by ``encode_value``."""
    if len(names) == 1:
        kind = df.schema[names[0]].dataType
        if isinstance(kind, (*_TEXTS, T.BinaryType)):
            return content_hash(names[0])
        if not _printed_alike(kind):
            return F.when(F.col(names[0]).isNotNull(), F.sha2(encode_value(F.col(names[0]), kind), 256))
        return content_hash(F.col(names[0]).cast("string"))
    return F.sha2(F.concat(*(encode_value(F.col(n), df.schema[n].dataType) for n in names)), 256)


_TEXTS = (T.StringType, T.CharType, T.VarcharType)
# Types whose printed form tells all their values apart, in every session.
_PRINTED = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType,
    T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType,
)


def _printed_alike(kind: T.DataType) -> bool:
    return isinstance(kind, (*_TEXTS, *_PRINTED))


def encode_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type as a string that no other value has.

    ``<bytes>:<text>;`` for what prints without ambiguity, ``-;`` for NULL. Bytes are in hex and moments as
    microseconds since the epoch, the same in every time zone. Elements, fields and entries are encoded
    each for itself, behind their number; entries of a map are in the order of their keys.
    """
    if isinstance(kind, T.ArrayType):
        text = _list(value, lambda x: encode_value(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.concat(encode_value(e.key, kind.keyType), encode_value(e.value, kind.valueType)),
        )
        text = _list(F.array_sort(pairs), lambda x: x)
    elif isinstance(kind, T.StructType):
        fields = [encode_value(value[f.name], f.dataType) for f in kind.fields]
        text = F.concat(F.lit(f"{len(fields)}("), *fields)
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif _printed_alike(kind):
        text = value.cast("string")
    else:
        raise ValueError(f"no unambiguous form of {kind.simpleString()} to hash")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";"))
    return F.when(value.isNull(), F.lit("-;")).otherwise(sized)


def _list(value: Column, each: Callable[[Column], Column]) -> Column:
    return F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(F.transform(value, each), ""))


def encode(*cols: Column | str) -> Column:
    """Columns as one string without ambiguity: ``<bytes>:<value>;`` each, ``-;`` for NULL."""
    parts = []
    for col in cols:
        text = _column(col).cast("string")
        parts.append(
            F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")), F.lit("-;"))
        )
    return F.concat(*parts)


def entity_id(*natural_key: Column | str) -> Column:
    """Deterministic entity id from the natural key, stable over retries and re-reads.

    A random id would change whenever a lost partition is computed again.
    """
    if len(natural_key) == 1:
        return F.sha2(_column(natural_key[0]).cast("string"), 256)
    return F.sha2(encode(*natural_key), 256)


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
