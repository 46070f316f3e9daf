"""The newest known state of every (provider, template)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.operators.rolling import FRAME, aliased, finished_stats, partial_stats
from moorage.schema import HISTORY_KEYS, HISTORY_STATS
from moorage.settle import settle


def newest_state(
    rolled: DataFrame, *, keys: Sequence[str] = HISTORY_KEYS, time: str = "timestamp"
) -> DataFrame:
    """Statistics of the newest row per key of an already rolled table.

    Rows of one instant share their statistics, so ties do not matter.
    """
    newest = F.max_by(F.struct(*HISTORY_STATS), F.col(time))
    return (
        rolled.groupBy(*keys)
        .agg(F.max(time).alias(time), newest.alias("_stats"))
        .select(*keys, time, *[F.col(f"_stats.{c}").alias(c) for c in HISTORY_STATS])
    )


def latest_state(
    rows: DataFrame,
    *,
    keys: Sequence[str] = HISTORY_KEYS,
    time: str = "timestamp",
    frame: timedelta = FRAME,
) -> DataFrame:
    """The same state straight from clean rows, without rolling the rest of history.

    Two hash aggregations, both combined before their shuffle: the newest instant per key, then the
    rows of one frame before it.  The instants are settled first, so a small key set is broadcast
    by its real size and the history is never shuffled; a large one is shuffled.
    """
    keys = list(keys)
    newest = settle(rows.groupBy(*keys).agg(F.max(time).alias("_newest")))
    recent = rows.join(newest, keys).where(F.col(time) > F.col("_newest") - F.lit(frame))
    return (
        recent.groupBy(*keys)
        .agg(F.max(time).alias(time), *aliased(partial_stats()))
        .select(*keys, time, *aliased(finished_stats()))
    )
