"""Stage logic written as plain Python functions: row transforms over Arrow batches and generators of entities as table functions.

For what column expressions cannot say. Only the columns a function asks for become Python values; all others pass by as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions.names import quoted
from snapdelta.functions.status import RESULT, RESULT_TYPE
from snapdelta.operators.components import declare
from snapdelta.plans.stages import Transform

# The helpers below travel with the tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Row = dict[str, Any]


@dataclass(frozen=True)
class Failed:
    """What a function returns for a row that failed: the message, and the components it has set all the same."""

    message: str | None = None
    components: Mapping[str, Any] = field(default_factory=dict)


def row_transform(function: Callable[[Row], Mapping[str, Any] | Failed | None], reads: Sequence[str], components: Mapping[str, str]) -> Transform:
    """A transform that calls ``function`` for every row.

    It gets the columns ``reads`` as a dictionary, structs as dictionaries too, and returns the components it sets, by name (None
    takes one away), ``Failed``, or nothing. Components it does not name stay. ``components`` declares the types of those it may set. A
    failure becomes the row's error, as with any transform; an exception ends the run.
    """

    def transform(df: DataFrame) -> DataFrame:
        rows = declare(df, components)
        schema = T.StructType([*rows.schema.fields, T.StructField(RESULT, T._parse_datatype_string(RESULT_TYPE))])

        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _called(batch.rename_columns(names), function, reads, list(components))

        # Columns go to Python by position, so that they may have names of any kind.
        return rows.toDF(*[f"_{position}" for position in range(len(names))]).mapInArrow(run, schema)

    return transform


_STATUS = pa.struct([("is_success", pa.bool_()), ("error_message", pa.string())])


def _called(batch: pa.RecordBatch, function: Callable, reads: Sequence[str], sets: Sequence[str]) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    given = zip(*(columns[name].to_pylist() for name in reads), strict=True) if reads else ((),) * batch.num_rows
    new = {name: columns[name].to_pylist() for name in sets}
    results = []
    for position, values in enumerate(given):
        outcome = function(dict(zip(reads, values, strict=True)))
        failed = isinstance(outcome, Failed)
        set_now = outcome.components if failed else outcome or {}
        if unknown := set(set_now) - set(sets):
            raise ValueError(f"components that were not declared: {', '.join(sorted(unknown))}")
        for name, value in set_now.items():
            new[name][position] = value
        results.append({"is_success": not failed, "error_message": outcome.message if failed else None})
    arrays = [pa.array(new[name], column.type) if name in new else column for name, column in columns.items()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(results, _STATUS)], [*columns, RESULT])


def entity_maker(function: Callable[[Row], Iterable[Mapping[str, Any]]], reads: Sequence[str], entity: str) -> Transform:
    """A generator for ``Stage.generators``: new entities from every row, by a Python table function joined laterally.

    ``function`` gets the columns ``reads`` as a dictionary and yields entities as dictionaries, from none to very many a row; they
    leave the task as they are made. ``entity`` declares key and components of the new entities, such as ``"entity_id string, line
    struct<text:string>"``. An entity may bring an ``error`` component of its own. What a dictionary leaves out is NULL.
    """
    schema = T._parse_datatype_string(entity)
    names = schema.names

    class Made:
        def eval(self, row):
            for made in function({name: _plain(row[name]) for name in reads}):
                yield tuple(made.get(name) for name in names)

    table = F.udtf(Made, returnType=schema)

    def generate(df: DataFrame) -> DataFrame:
        given = df.select(F.struct(*[quoted(name) for name in reads]).alias("row"))
        return given.lateralJoin(table(F.col("row").outer())).drop("row")

    return generate


def _plain(value: Any) -> Any:
    return value.asDict(recursive=True) if isinstance(value, T.Row) else value
