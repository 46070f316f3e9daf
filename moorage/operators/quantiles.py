"""Exact, linearly interpolated quantiles of many columns, at any size."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.functions.scores import number_or_null
from moorage.settle import settle

#: Distinct values that may be put in order inside one task.
IN_ONE_TASK = 1_000_000
#: The approximate aggregate's ranks are off by less than this share of the rows.
_ACCURACY = 10_000
_BINS = 4096
_LARGEST = sys.float_info.max


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    in_one_task: int = IN_ONE_TASK,
) -> dict[str, list[float | None]]:
    """Column -> its quantiles, null and NaN left out; None for a column without values.

    The result is one number per (column, probability), so it is returned, not left in a table.
    ``df`` is read up to three times: settle it first when it is costly to compute.

    One aggregation over all columns gives counts, ends, and from a mergeable sketch with a bound on its rank error a
    bracket around each wanted rank. A second pass counts what lies below the brackets; where they hold more than one value, a third
    puts in order the distinct values inside, which are those of a few of ten thousand rows. Where even they are too many for one task they are
    narrowed by histogram first.
    """
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    if not columns:
        return {}
    numbers = df.select(*[number_or_null(F.col(c)).alias(c) for c in columns])
    slots, brackets, rows = _brackets(numbers, columns, probabilities)
    found = {}
    # Rows between the ends of a bracket; copies of the ends count once each.
    inside = rows if rows <= _ACCURACY else 6 * rows / _ACCURACY + 2
    if brackets and inside <= in_one_task:
        found = _ordered_inside(numbers, slots, brackets)
    missing = {s: brackets[s] for s in brackets if s not in found}
    if missing:
        found.update(_narrowed(numbers, slots, missing, in_one_task))

    result = {c: [None] * len(probabilities) for c in columns}
    for slot, (c, i, _, fraction) in slots.items():
        pair = found[slot]
        result[c][i] = pair[0] if len(pair) == 1 else _between(*pair, fraction)
    return result


def _ranks(slot: tuple) -> list[int]:
    _, _, rank, fraction = slot
    return [rank, rank + 1] if fraction > 0 else [rank]


def _brackets(numbers, columns, probabilities):
    """Slots (one per column and probability), where to look for each, and the rows of the fullest column.

    A slot is ``(column, index, 0-based rank, fraction towards the next rank)``.
    """
    # Twice the error, and a rank for rounding, to either side.
    around = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-2 / _ACCURACY, 2 / _ACCURACY)]
    near = F.array(*[F.lit(p) for p in around])
    facts = numbers.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.percentile_approx(c, near, F.lit(_ACCURACY)).alias(f"near_{c}") for c in columns],
    ).first()
    slots, brackets = {}, {}
    for c in columns:
        n, low, high, guess = (facts[f"{k}_{c}"] for k in ("n", "lo", "hi", "near"))
        for i, p in enumerate(probabilities):
            if not n:
                continue
            place = (n - 1) * p
            slot, rank = f"{c}#{i}", math.floor(place)
            slots[slot] = (c, i, rank, place - rank)
            # Few rows are within the error altogether: then the bracket is the column's whole range.
            sure = guess is not None and n > _ACCURACY
            brackets[slot] = (
                c,
                guess[2 * i] if sure and around[2 * i] > 0 else low,
                guess[2 * i + 1] if sure and around[2 * i + 1] < 1 else high,
            )
    return slots, brackets, max(facts[f"n_{c}"] for c in columns)


def _entries(numbers: DataFrame, brackets: dict) -> DataFrame:
    """(slot, value, n): counted distinct values inside each bracket; a null value stands for all rows below it."""
    entries = [
        F.when(
            F.col(c) <= F.lit(high),
            F.struct(F.lit(slot).alias("slot"), F.when(F.col(c) >= F.lit(low), F.col(c)).alias("value")),
        )
        for slot, (c, low, high) in brackets.items()
    ]
    entry = F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")
    return numbers.select(entry).groupBy("e.slot", "e.value").agg(F.count(F.lit(1)).alias("n"))


def _ordered_inside(numbers: DataFrame, slots: dict, brackets: dict) -> dict[str, list[float]]:
    """slot -> values at its ranks; slots whose bracket misses a rank are left out.

    Rows below and up to the end of each bracket are plain counts of one aggregation, which is all that brackets of one value
    need; only the rows inside the others are taken out and put in order.
    """
    names = list(brackets)
    ends = [F.array(F.count_if(F.col(c) < F.lit(low)), F.count_if(F.col(c) <= F.lit(high))) for c, low, high in brackets.values()]
    counts = numbers.agg(F.array(*ends).alias("ends")).first()["ends"]
    found, open_slots = {}, {}
    for slot, (below, upto) in zip(names, counts):
        _, low, high = brackets[slot]
        ranks = _ranks(slots[slot])
        if not below <= ranks[0] <= ranks[-1] < upto:
            continue
        if low == high:
            found[slot] = [low] * len(ranks)
        else:
            open_slots[slot] = below
    if not open_slots:
        return found

    def by_slot(values: dict) -> Column:
        entries = [F.struct(F.lit(s).alias("slot"), v.alias("value")) for s, v in values.items()]
        return F.map_from_entries(F.array(*entries))[F.col("slot")]

    inside = [
        F.when(F.col(c).between(low, high), F.struct(F.lit(slot).alias("slot"), F.col(c).alias("value")))
        for slot, (c, low, high) in brackets.items()
        if slot in open_slots
    ]
    any_inside = F.explode(F.array_compact(F.array(*inside))).alias("e")
    counted = numbers.select(any_inside).groupBy("e.slot", "e.value").agg(F.count(F.lit(1)).alias("n"))
    upto = by_slot({s: F.lit(n).cast("bigint") for s, n in open_slots.items()}) + F.sum("n").over(Window.partitionBy("slot").orderBy("value"))
    ranks = by_slot({s: F.array(*[F.lit(k).cast("bigint") for k in _ranks(slots[s])]) for s in open_slots})
    placed = counted.withColumn("upto", upto).withColumn("ranks", ranks)
    held = F.filter("ranks", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))
    values: dict[str, dict[int, float]] = {}
    for r in placed.select("slot", "value", held.alias("held")).where(F.size("held") > 0).collect():
        values.setdefault(r["slot"], {}).update(dict.fromkeys(r["held"], r["value"]))
    return found | {s: [v[k] for k in _ranks(slots[s])] for s, v in values.items()}


def _narrowed(numbers: DataFrame, slots: dict, brackets: dict, in_one_task: int) -> dict[str, list[float]]:
    """The same for brackets with too many distinct values; a bracket that misses a rank is widened to all values."""
    found, pending = {}, brackets
    while pending:
        counted = settle(_entries(numbers, pending))
        below, inside = {}, {}
        for r in counted.groupBy("slot", F.col("value").isNull().alias("outside")).agg(F.sum("n").alias("n")).collect():
            (below if r["outside"] else inside)[r["slot"]] = r["n"]
        wanted = {}
        for slot in pending:
            ranks = [k - below.get(slot, 0) for k in _ranks(slots[slot])]
            if ranks[0] >= 0 and ranks[-1] < inside.get(slot, 0):
                wanted[slot] = ranks
        found.update(_ranked_values(counted.where(F.col("value").isNotNull()), wanted, in_one_task))
        pending = {s: (c, float("-inf"), float("inf")) for s, (c, _, _) in pending.items() if s not in wanted}
    return found


def _between(low: float, high: float, fraction: float) -> float:
    """The point between two neighbours; equal ones (infinite ones too) are their own."""
    return low if low == high else (1 - fraction) * low + fraction * high


def _ranked_values(values: DataFrame, wanted: dict[str, list[int]], in_one_task: int):
    """slot -> values at its 0-based ranks, from counted distinct values ``(slot, value, n)``."""
    if not wanted:
        return {}
    found = {slot: {} for slot in wanted}
    values = values.where(F.col("slot").isin(list(wanted)))
    # Ranges still to be searched: (slot, lower, upper) -> (rows of the slot below it, ranks).
    extent = values.groupBy("slot").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ranges = {(r["slot"], r["lo"], r["hi"]): (0, wanted[r["slot"]]) for r in extent.collect()}
    while ranges:
        cells = values.sparkSession.createDataFrame(
            [(slot, lo, hi) for slot, lo, hi in ranges], "slot string, lo double, hi double"
        )
        spread = (
            values.join(F.broadcast(cells), "slot")  # two ranges per (column, probability) at most
            .where(F.col("value").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi")))
        )
        bins = (
            spread.groupBy("slot", "lo", "hi", "bin")
            .agg(
                F.sum("n").alias("n"),
                F.count(F.lit(1)).alias("distinct"),
                F.min("value").alias("first"),
                F.max("value").alias("last"),
            )
            .collect()
        )
        narrowed, small = {}, {}
        for (slot, lo, hi), (base, ranks) in ranges.items():
            seen = base
            for b in sorted(
                (b for b in bins if (b["slot"], b["lo"], b["hi"]) == (slot, lo, hi)), key=lambda b: b["bin"]
            ):
                here = [r for r in ranks if seen <= r < seen + b["n"]]
                if here and b["first"] == b["last"]:
                    found[slot].update({r: b["first"] for r in here})
                elif here:
                    target = small if b["distinct"] <= in_one_task else narrowed
                    target[(slot, b["first"], b["last"])] = (seen, here)
                seen += b["n"]
        for r in _ordered(values, small):
            base, ranks = small[(r["slot"], r["lo"], r["hi"])]
            found[r["slot"]].update({k: r["value"] for k in ranks if base + r["before"] <= k < base + r["upto"]})
        ranges = narrowed
    return {slot: [found[slot][r] for r in ranks] for slot, ranks in wanted.items()}


def _bin(value: Column, low: Column, high: Column) -> Column:
    """The bin of a value in a range: infinite values have bins of their own, the others share the finite range.

    Halves keep the width of a range finite, however far its ends lie apart.
    """
    low, high = F.greatest(low, F.lit(-_LARGEST)), F.least(high, F.lit(_LARGEST))
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    inside = F.coalesce(F.least(F.floor(share * _BINS), F.lit(_BINS - 1)), F.lit(0))
    return F.when(value < -_LARGEST, F.lit(-1)).when(value > _LARGEST, F.lit(_BINS)).otherwise(inside)


def _ordered(values: DataFrame, small: dict) -> list:
    """The few counted values that cover the wanted ranks of small ranges."""
    if not small:
        return []
    cells = values.sparkSession.createDataFrame(
        [(slot, lo, hi, base, ranks) for (slot, lo, hi), (base, ranks) in small.items()],
        "slot string, lo double, hi double, base bigint, ranks array<bigint>",
    )
    run = Window.partitionBy("slot", "lo", "hi").orderBy("value")
    ordered = (
        values.join(F.broadcast(cells), "slot")
        .where(F.col("value").between(F.col("lo"), F.col("hi")))
        .withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("n"))
    )
    wanted = F.exists(
        "ranks",
        lambda k: (k >= F.col("base") + F.col("before")) & (k < F.col("base") + F.col("upto")),
    )
    return ordered.where(wanted).collect()
