"""Removal of rows outside the inter-quartile fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.functions.scores import number_or_null
from moorage.operators.quantiles import exact_quantiles

Fences = dict[str, tuple[float, float]]


def iqr_fences(
    df: DataFrame, columns: Sequence[str], *, q1: float = 0.25, q3: float = 0.75, k: float = 1.5, **search
) -> Fences:
    """Column -> (q1 - k * iqr, q3 + k * iqr)."""
    fences = {}
    for name, (low, high) in exact_quantiles(df, columns, [q1, q3], **search).items():
        if low is not None:
            reach = k * (high - low)
            fences[name] = (low - reach, high + reach)
    return fences


def within_fences(df: DataFrame, fences: Fences) -> DataFrame:
    """Rows with no value beyond its fence.  Null and NaN are beyond nothing.

    The fences are literals, so this is a plain filter that costs no join.
    """
    kept = F.lit(True)
    for name, (low, high) in fences.items():
        value = number_or_null(F.col(name))
        kept = kept & ~F.coalesce((value < F.lit(low)) | (value > F.lit(high)), F.lit(False))
    return df.where(kept)


def iqr_filter(
    df: DataFrame, columns: Sequence[str], *, q1: float = 0.25, q3: float = 0.75, k: float = 1.5, **search
) -> DataFrame:
    """Drop the rows with an outlier in any of ``columns``.

    Pass features and target together to clean both at once.  Mind that a 0/1 target whose rarer
    class is below a quarter has no spread: the rarer class then counts as outliers and goes
    as a whole.
    """
    return within_fences(df, iqr_fences(df, columns, q1=q1, q3=q3, k=k, **search))
