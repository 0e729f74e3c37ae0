"""Named stages of table transforms, chained into a pipeline with row-level errors.

A transform is any ``DataFrame -> DataFrame`` function. It may add a ``_result`` status column (see
``functions.status``); rows with a failed status get an ``error`` component and go on like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.status import RESULT
from snapdelta.operators.components import COMPONENTS, ERROR, declare, populated
from snapdelta.session import scratch_dir

Transform = Callable[[DataFrame], DataFrame]

# Fixed value: the name of a stage that was given none.
UNNAMED = "Unnamed Pipe"
_GIVEN = "_snapdelta_given"


@dataclass(frozen=True)
class Stage:
    """Transforms that run in order over all rows.

    ``generators`` take the rows the stage was given and return new entities, which the following
    stages see. ``components`` declares the component columns the stage adds. ``cut=True`` writes
    the outcome to the shared scratch folder and goes on from there: for stages whose work is too
    dear to repeat when an executor is lost or when several actions need the outcome.
    """

    name: str = UNNAMED
    transforms: Sequence[Transform] = ()
    generators: Sequence[Transform] = ()
    components: Mapping[str, str] = field(default_factory=dict)
    cut: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        """Run the transforms and record the failures of each before the next one starts."""
        df = declare(df, {**self.components, ERROR: COMPONENTS[ERROR]})
        return reduce(lambda rows, transform: record_errors(transform(rows)), self.transforms, df)

    def generate(self, df: DataFrame) -> list[DataFrame]:
        """The new entities this stage makes from the rows it was given."""
        return [generator(df) for generator in self.generators]


@dataclass(frozen=True)
class Pipeline:
    """Stages in order over one wide entity table.

    After each stage the table holds every entity with at least one component: those made by the
    stage join it, and those left without any component drop out.
    """

    stages: Sequence[Stage] = ()
    key: Sequence[str] = ("entity_id",)

    def run(
        self, entities: DataFrame, storage: DataFrame | None = None, distinct_input: bool = False
    ) -> DataFrame:
        """Plan all stages over ``entities``; lazy except for stages that cut.

        The first stage sees the rows as given, duplicates included. They collapse after it, for
        which ``distinct_input=True`` saves the shuffle when there are none. With ``storage``, the
        given entities take their components from there, and the other stored entities join in
        from the second stage on.
        """
        key = list(self.key)
        others = None
        if storage is None:
            rows = entities
        else:
            # One join for both: the given entities with what is stored of them, and what else is stored.
            given = entities.select(*key, F.lit(True).alias(_GIVEN))
            joined = given.join(storage, key, "full")
            rows = joined.where(F.col(_GIVEN)).drop(_GIVEN)
            others = joined.where(F.col(_GIVEN).isNull()).drop(_GIVEN)
        for position, stage in enumerate(self.stages):
            made = stage.generate(rows)
            rows = stage.apply(rows)
            if position == 0:
                rows = rows if distinct_input else rows.dropDuplicates(key)
                if others is not None:
                    made.append(others)
            rows = populated(_append(rows, made), key)
            if stage.cut:
                rows = _written(rows, stage.name)
        return rows


def record_errors(df: DataFrame) -> DataFrame:
    """Turn the status left by a transform into the error component: the last failure is kept."""
    if RESULT not in df.columns:
        return df
    failed = ~F.col(RESULT)["is_success"]
    message = F.struct(F.col(RESULT)["error_message"].alias("error_message"))
    return df.withColumn(ERROR, F.when(failed, message).otherwise(F.col(ERROR))).drop(RESULT)


def errors(df: DataFrame) -> DataFrame:
    """Rows that failed in some stage."""
    return df.where(F.col(ERROR).isNotNull())


def clean(df: DataFrame) -> DataFrame:
    """Rows that never failed."""
    return df.where(F.col(ERROR).isNull())


def _append(rows: DataFrame, made: Sequence[DataFrame]) -> DataFrame:
    for new in made:
        rows = rows.unionByName(new, allowMissingColumns=True)
    return rows


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_dir(spark, "stage-" + "-".join(name.lower().split()))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
