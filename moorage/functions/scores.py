"""Column expressions that turn predictions into comparable scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(value: Column) -> Column:
    """NaN as null, so that comparisons follow the rule 'NaN is neither below nor above'."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def duration_goodness(expected: Column, fastest: Column, slowest: Column) -> Column:
    """Place of an expected time between the slowest (0) and the fastest (1) known success.

    Without a usable range the answer is 1.  A NaN prediction stays NaN: ``least``/``greatest``
    would otherwise turn it into 1.
    """
    has_range = (slowest > 0) & (slowest != fastest)
    raw = 1 - (expected - fastest) / (slowest - fastest)
    clipped = F.when(F.isnan(raw), raw).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    return F.when(has_range, clipped).otherwise(F.lit(1.0))
