"""Entities as rows, components as nullable struct columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.names import quoted

ERROR = "error"

# Component types of the built-in flows.
COMPONENTS: dict[str, str] = {
    "file_path": "struct<file_path:string>",
    "file_time": "struct<modified:timestamp>",
    "file_hash": "struct<current_hash:string,previous_hash:string>",
    "backup_date": "struct<backup_date:timestamp>",
    "backup_dates": "struct<dates:array<timestamp>>",
    ERROR: "struct<error_message:string>",
}


def component_columns(df: DataFrame, key: Sequence[str]) -> list[str]:
    """Names of the component columns: every struct column outside the key."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StructType) and f.name not in key]


def declare(df: DataFrame, components: Mapping[str, str]) -> DataFrame:
    """Add the components that ``df`` does not have yet as typed NULLs."""
    missing = {n: F.lit(None).cast(t) for n, t in components.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def seed_entities(df: DataFrame, natural_key: Column, entity_id: Column) -> DataFrame:
    """One entity per distinct natural key, holding that key as its path component."""
    seeds = df.select(natural_key.alias("_path")).distinct()
    path = F.col("_path")
    return seeds.select(
        entity_id.alias("entity_id"), F.struct(path.alias("file_path")).alias("file_path")
    )


def set_component(df: DataFrame, name: str, value: Column, where: Column | None = None) -> DataFrame:
    """Replace a whole component; with ``where``, only on the rows for which it is true."""
    if where is None:
        return df.withColumn(name, value)
    kept = F.col(name) if name in df.columns else F.lit(None)
    return df.withColumn(name, F.when(where, value).otherwise(kept))


def has_component(*names: str) -> Column:
    """True where all the named components are present."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def get_component(entities: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach the columns of a component table; NULL where the entity has no row there."""
    return entities.join(table, list(key), "left")


def with_component(entities: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities that have a row in the component table."""
    return entities.join(table.select(*key), list(key), "left_semi")


def missing_component(entities: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities that have no row in the component table."""
    return entities.join(table.select(*key), list(key), "left_anti")


def populated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities of a wide table that have at least one component."""
    names = component_columns(df, key)
    if not names:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a | b, [F.col(quoted(n)).isNotNull() for n in names]))


def list_entities(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys found in any of several component tables, once each."""
    return reduce(DataFrame.unionByName, [t.select(*key) for t in tables]).distinct()


def latest(feed: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Last write per key from a feed in any order; a NULL payload may be the last write.

    An aggregate rather than a ranking window: each task keeps one row per key before the shuffle,
    so a key that owns a third of the feed costs no more than any other.
    """
    last = F.max_by(F.struct(*payload), F.struct(*order)).alias("_last")
    return feed.groupBy(*key).agg(last).select(*key, "_last.*")


def from_feed(
    feed: DataFrame, key: Sequence[str], components: Mapping[str, str], order: Sequence[str] = ("seq",),
    kind: str = "component_type", payload: str = "payload",
) -> DataFrame:
    """The wide entity table of a long feed of component writes in any order: the last write by ``order`` of each key and type.

    A payload is a JSON object as text, or a VARIANT, of its component's declared type. A NULL payload, or a JSON null, takes the
    component away, so that an entity without any other drops out. Writes of the same order are told apart by their payloads as text, the
    greater one winning. A payload that is not of its type leaves the entity without the component and with an error that names
    it. Types that are not declared are left out.

    One shuffle: a key's last writes of all types are found by one aggregate, with a partial step before it.
    """
    variant = isinstance(feed.schema[payload].dataType, T.VariantType)
    text = F.to_json(F.col(payload)) if variant else F.col(payload)
    written = feed.where(F.col(kind).isin(*components))
    written = written.select(*key, F.col(kind).alias("_kind"), F.struct(*order, text).alias("_order"), text.alias("_text"))

    def last(name: str) -> Column:
        mine = F.col("_kind") == name
        return F.max_by(F.when(mine, F.struct("_text")), F.when(mine, F.col("_order")))["_text"].alias(name)

    wide = written.groupBy(*key).agg(*[last(name) for name in components])
    given = {name: F.when(F.trim(F.col(name)) == "null", None).otherwise(F.col(name)) for name in components}
    parsed = {name: F.from_json(given[name], _with_rest(kind_of), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rest"}) for name, kind_of in components.items()}
    bad = {name: given[name].isNotNull() & (parsed[name].isNull() | parsed[name]["_rest"].isNotNull()) for name in components}
    message = F.concat(F.lit("Component malformed: "), F.array_join(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()])), ", "))
    error = F.when(reduce(lambda a, b: a | b, bad.values()), F.struct(message.alias("error_message"))).alias(ERROR)
    values = [F.when(~bad[n] & given[n].isNotNull(), parsed[n].dropFields("_rest")).cast(t).alias(n) for n, t in components.items()]
    return populated(wide.select(*key, *values, error), key)


def _with_rest(kind: str) -> T.StructType:
    """A component's type with room for a text that does not fit it."""
    return T.StructType([*T._parse_datatype_string(kind).fields, T.StructField("_rest", T.StringType())])


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``updates`` put over it; an update to NULL counts.

    Both sides hold a key at most once (collapse a feed with ``latest`` first).
    """
    values = [c for c in base.columns if c not in key]
    joined = base.alias("b").join(updates.withColumn("_hit", F.lit(True)).alias("u"), list(key), "full")
    hit = F.col("u._hit").isNotNull()
    return joined.select(*key, *[F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values])
