"""Rolling success, failure and duration statistics per (provider, template).

Every row at time ``t`` sees the rows of its key in ``(t - frame, t]``: the lower end is open, rows
of the same instant and the row itself are included.

A plain ``RANGE`` window is right but does not scale: Spark re-adds the whole frame for each
row, and all rows of one key meet in one task.  ``rolling_stats`` gets the same answer in linear
time, split by time:

1. Rows are pre-aggregated to one partial per (key, instant); a hot instant collapses before the
   shuffle.
2. Time is cut into ``grains`` per frame.  For an instant in grain ``g`` the frame is exactly
   *the tail of grain g-grains* + *the whole grains between* + *the head of grain g*.
3. Head and tail are running aggregates inside one (key, grain), so one key spreads over as many
   tasks as it has grains.  To put the tail beside its users each partial is copied, shifted by one
   frame, into grain ``g + grains``.
4. The whole grains in between come from grain totals, a table with one row per (key, grain).

Only sums, counts, minima and maxima are combined, and nothing is subtracted, so there is no
cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.functions.clock import micros, to_micros
from moorage.schema import FAILED, HISTORY_KEYS, HISTORY_STATS, SUCCEEDED
from moorage.settle import settle

FRAME = timedelta(days=30)

#: Partials and how two of them are merged.
MERGE = {
    "n_failed": F.sum,
    "n_ok": F.sum,
    "time_failed": F.sum,
    "time_ok": F.sum,
    "slowest_ok": F.max,
    "fastest_ok": F.min,
}
_HOME, _TAIL, _MIDDLE = 0, 1, 2


def partial_stats() -> dict[str, Column]:
    """Aggregates over rows from which ``finished_stats`` computes the five statistics."""
    ok, failed = F.col("status") == SUCCEEDED, F.col("status") == FAILED
    spent = F.col("deployment_time")
    return {
        "n_failed": F.count_if(failed),
        "n_ok": F.count_if(ok),
        "time_failed": F.sum(F.when(failed, spent)),
        "time_ok": F.sum(F.when(ok, spent)),
        "slowest_ok": F.max(F.when(ok, spent)),
        # A success that never reported a completion time has no valid fastest time.
        "fastest_ok": F.min(F.when(ok & (F.col("completion_time_s") > 0), spent)),
    }


def aliased(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def finished_stats(part=F.col) -> dict[str, Column]:
    """The five statistics from (merged) partials; nothing to average gives 0."""

    def mean(total: str, *counts: str) -> Column:
        rows = reduce(add, [part(c) for c in counts])
        return F.coalesce(F.try_divide(part(total).cast("double"), rows.cast("double")), F.lit(0.0))

    return {
        "failure_percentage": mean("n_failed", "n_ok", "n_failed"),
        "avg_success_time": mean("time_ok", "n_ok"),
        "avg_failure_time": mean("time_failed", "n_failed"),
        "max_success_time": F.coalesce(part("slowest_ok"), F.lit(0.0)),
        "min_success_time": F.coalesce(part("fastest_ok"), F.lit(0.0)),
    }


def _merged(names_to: str, window, only: Column | None = None) -> dict[str, Column]:
    """Running merge of all partials over ``window``, restricted to rows where ``only`` holds."""
    pick = (lambda c: F.when(only, F.col(c))) if only is not None else F.col
    return {f"{names_to}_{c}": merge(pick(c)).over(window) for c, merge in MERGE.items()}


def _joined(name: str, parts: Sequence[str]) -> Column:
    cols = [F.col(f"{p}_{name}") for p in parts]
    merge = MERGE[name]
    if merge is F.sum:
        # A part that saw no row adds nothing; min and max skip nulls by themselves.
        return reduce(add, [F.coalesce(c, F.lit(0)) for c in cols])
    return (F.greatest if merge is F.max else F.least)(*cols)


def rolling_stats(
    rows: DataFrame,
    *,
    keys: Sequence[str] = HISTORY_KEYS,
    time: str = "timestamp",
    frame: timedelta = FRAME,
    grains: int = 30,
    include_current: bool = True,
) -> DataFrame:
    """The five statistics for each distinct (keys, time) of ``rows``.

    ``grains`` is the number of time slices a frame is cut into; raise it when a single slice of
    a hot key is still too much for one task.  With ``include_current=False`` the frame ends just
    before ``t``, so a row never sees its own label.
    """
    keys = list(keys)
    span = to_micros(frame)
    if grains < 1 or span % grains:
        raise ValueError(f"a frame of {frame} cannot be cut into {grains} equal slices")
    width = span // grains

    # Settled, as slices, shifted copies and slice totals all come from it: the rows behind it are read once.
    instants = settle(
        rows.groupBy(*keys, time)
        .agg(*aliased(partial_stats()))
        .withColumn("at", micros(rows, time))
        .withColumn("grain", F.expr(f"(at - pmod(at, {width}L)) div {width}L"))
    )
    spread = instants.withColumn(
        "place",
        F.explode(
            F.array(
                F.struct(F.lit(_HOME).alias("role"), F.col("grain"), F.col("at")),
                F.struct(
                    F.lit(_TAIL).alias("role"),
                    (F.col("grain") + F.lit(grains)).alias("grain"),
                    (F.col("at") + F.lit(span)).alias("at"),
                ),
            )
        ),
    ).select(*keys, time, *MERGE, "place.role", "place.grain", "place.at")

    if grains > 1:
        between = Window.partitionBy(*keys).orderBy("grain").rangeBetween(-(grains - 1), -1)
        totals = instants.groupBy(*keys, "grain").agg(*[m(c).alias(c) for c, m in MERGE.items()])
        middles = totals.select(
            *keys,
            F.lit(None).cast(rows.schema[time].dataType).alias(time),
            *[m(c).over(between).alias(c) for c, m in MERGE.items()],
            F.lit(_MIDDLE).alias("role"),
            "grain",
            # Just before the slice starts, so that every instant of the slice sees it.
            (F.col("grain") * F.lit(width) - 1).alias("at"),
        )
        spread = spread.unionByName(middles)

    cell = Window.partitionBy(*keys, "grain")
    head = cell.orderBy("at").rangeBetween(Window.unboundedPreceding, 0 if include_current else -1)
    # Downwards in time, homes before tails: a tail exactly one frame old is outside.
    tail = cell.orderBy(F.col("at").desc(), "role").rowsBetween(Window.unboundedPreceding, 0)
    framed = spread.withColumns(
        {
            **_merged("head", head, F.col("role") != _TAIL),
            **_merged("tail", tail, F.col("role") == _TAIL),
        }
    ).where(F.col("role") == _HOME)
    whole = framed.select(*keys, time, *[_joined(c, ["head", "tail"]).alias(c) for c in MERGE])
    return whole.select(*keys, time, *aliased(finished_stats()))


def rolling_history(
    rows: DataFrame,
    *,
    keys: Sequence[str] = HISTORY_KEYS,
    time: str = "timestamp",
    frame: timedelta = FRAME,
    grains: int = 30,
    include_current: bool = True,
) -> DataFrame:
    """``rows`` with the five rolling statistics of its key and instant added.

    The statistics have one row per (keys, time), so the join never multiplies rows, and a hot
    instant lies on the ``rows`` side only, which adaptive execution may split.
    """
    stats = rolling_stats(
        rows, keys=keys, time=time, frame=frame, grains=grains, include_current=include_current
    )
    return rows.join(stats, [*keys, time], "left").select(*rows.columns, *HISTORY_STATS)


def rolling_history_by_frame(
    rows: DataFrame,
    *,
    keys: Sequence[str] = HISTORY_KEYS,
    time: str = "timestamp",
    frame: timedelta = FRAME,
) -> DataFrame:
    """The same statistics from one ``RANGE`` window: for short histories with even keys.

    Costs rows times rows-per-frame, with a whole key in one task.
    """
    at = "_at"
    window = Window.partitionBy(*keys).orderBy(at).rangeBetween(1 - to_micros(frame), 0)
    partials = {f"_{name}": part.over(window) for name, part in partial_stats().items()}
    return (
        rows.withColumn(at, micros(rows, time))
        .withColumns(partials)
        .withColumns(finished_stats(lambda name: F.col(f"_{name}")))
        .select(*rows.columns, *HISTORY_STATS)
    )
