"""The newest state of every (provider, template), kept up to date by daily partials.

Every ingested batch leaves one partial per (key, day). Partials of a day merge in any order, so the newest state comes
from them, and history itself is read only for the day on which a key's frame begins, from the months of those days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.operators.cleaning import clean, derive
from moorage.operators.rolling import FRAME, MERGE, aliased, finished_stats, partial_stats
from moorage.schema import HISTORY_KEYS
from moorage.settle import settle

#: Column of the history table that its folders are named by.
MONTH = "month"


def month_of(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM")


def day_partials(rows: DataFrame, *, keys: Sequence[str] = HISTORY_KEYS, time: str = "timestamp") -> DataFrame:
    """One row per key and day of clean rows: mergeable statistics and the newest instant."""
    return rows.groupBy(*keys, F.to_date(time).alias("day")).agg(F.max(time).alias("newest"), *aliased(partial_stats()))


def merged_days(partials: DataFrame, *, keys: Sequence[str] = HISTORY_KEYS) -> DataFrame:
    """Partials of any number of batches as one row per key and day."""
    return partials.groupBy(*keys, "day").agg(F.max("newest").alias("newest"), *_merged())


def _merged() -> list:
    return [merge(c).alias(c) for c, merge in MERGE.items()]


def state_of_days(
    partials: DataFrame,
    history: DataFrame,
    *,
    complex_templates: Sequence[str] = (),
    frame: timedelta = FRAME,
    keys: Sequence[str] = HISTORY_KEYS,
    time: str = "timestamp",
) -> DataFrame:
    """Newest statistics per key, as :func:`moorage.operators.latest.latest_state` has them from all rows.

    ``history`` is the raw table with its ``month`` column. A frame is whole days, from their partials, and the
    part of its first day after its beginning, from the rows of that day.
    """
    keys = list(keys)
    days = settle(merged_days(partials, keys=keys))
    newest = days.groupBy(*keys).agg(F.max("newest").alias("_newest"))
    begin = F.col("_newest") - F.lit(frame)
    newest = settle(newest.withColumns({"_begin": begin, "_first_day": F.to_date(begin)}))
    whole = days.join(newest, keys).where(F.col("day") > F.col("_first_day")).select(*keys, "_newest", *MERGE)

    # As many as there are months in which some key's frame begins.
    months = [r[0] for r in newest.select(month_of("_first_day")).distinct().collect()]
    rows = derive(clean(history.where(F.col(MONTH).isin(months)).drop(MONTH, "batch_id")), complex_templates=complex_templates)
    tail = rows.join(newest, keys).where((F.to_date(time) == F.col("_first_day")) & (F.col(time) > F.col("_begin")))
    tail = tail.groupBy(*keys, "_newest").agg(*aliased(partial_stats()))
    merged = whole.unionByName(tail).groupBy(*keys).agg(F.max("_newest").alias(time), *_merged())
    return merged.select(*keys, time, *aliased(finished_stats()))
