"""Change detection of keyed content against stored hashes.

All frames here are narrow (key and hashes). The content itself is hashed where it is read and never
takes part in these joins, so a run shuffles some hundred bytes per row, whatever the content weighs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prior(current: DataFrame, state: DataFrame | Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Attach ``previous_hash``; NULL where the state does not know the key.

    The state may come in tiers, newest first, each with a key at most once; the first that knows a key counts. Tiers bucketed by
    key are joined as they lie: only ``current`` is shuffled, and once for all of them.
    """
    tiers = [state] if isinstance(state, DataFrame) else state
    rows, known = current, [F.lit(None).cast("struct<content_hash:string>")]
    for age, tier in enumerate(tiers):
        prior = tier.select(*key, F.struct("content_hash").alias(f"_prior_{age}"))
        rows = rows.join(prior, list(key), "left")
        known.append(F.col(f"_prior_{age}"))
    previous = F.coalesce(*known)["content_hash"].alias("previous_hash")
    return rows.select(*[current[c] for c in current.columns], previous)


def changed(current: Column, previous: Column) -> Column:
    """True for new and for changed content; two NULLs count as unchanged."""
    return ~current.eqNullSafe(previous)


def stamp(when: Column, moment: Column) -> Column:
    """The ``backup_date`` component on the rows to back up, else NULL."""
    return F.when(when, F.struct(moment.cast("timestamp").alias("backup_date")))


def merge_state(state: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """State after a run: updated keys take the new hash, all others stay, none is removed."""
    new = updates.select(*key, F.col("content_hash").alias("_new"), F.lit(True).alias("_updated"))
    merged = state.select(*key, "content_hash").join(new, list(key), "full")
    return merged.select(*key, F.when(F.col("_updated"), F.col("_new")).otherwise(F.col("content_hash")).alias("content_hash"))
