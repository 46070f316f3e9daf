"""Candidates joined with the newest history of their (provider, template)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.schema import HISTORY_KEYS, HISTORY_STATS


def enrich(candidates: DataFrame, state: DataFrame, *, keys: Sequence[str] = HISTORY_KEYS) -> DataFrame:
    """Left join on (provider, template); a candidate without history gets 0.0 everywhere.

    Each candidate sees its own key's history, whatever its place in the message.  The newest row
    counts however old it is.  ``state`` has one row per key; a settled one is broadcast when its
    files are small, and otherwise a hot key lies on the candidate side, which may be split.
    """
    known = state.select(*keys, *HISTORY_STATS)
    joined = candidates.join(known, list(keys), "left")
    return joined.select(
        *candidates.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in HISTORY_STATS]
    )
