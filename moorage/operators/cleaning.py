"""From raw history rows to clean, feature-bearing rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorage.functions import features as feat

# Columns that never take part in learning.
NOT_FEATURES = ["uuid", "status_reason", "user_group"]


def clean(
    history: DataFrame,
    *,
    required: Sequence[str] | None = None,
    time_formats: Sequence[str] = (),
) -> DataFrame:
    """Label, time-stamp and de-null history rows.

    ``status_reason`` and ``user_group`` go; ``uuid`` stays as the row's identity but is no
    feature.  A row with a null or NaN in any other column is dropped, also in columns no model
    reads.  ``required`` narrows that test to the named columns (plus the three derived here), which
    lets the scan skip all others.
    """
    absent = [c for c in NOT_FEATURES if c not in history.columns]
    if absent:
        raise ValueError(f"history lacks the columns {absent}")
    dropped = [c for c in NOT_FEATURES if c != "uuid"]
    labelled = history.drop(*dropped).withColumns(
        {
            "status": feat.outcome(F.col("status")),
            "timestamp": feat.parsed_time(F.col("submission_time"), time_formats),
            "deployment_time": feat.deployment_time(
                F.col("completion_time_s"), F.col("tot_failure_time_s"), F.col("n_failures")
            ),
        }
    )
    checked = [c for c in labelled.columns if c != "uuid"]
    if required is not None:
        checked = sorted({*required, "status", "timestamp", "deployment_time"})
    return labelled.where(_complete(labelled, checked))


def _complete(rows: DataFrame, columns: Sequence[str]) -> Column:
    """No null and no NaN in ``columns``.

    One test per column, unlike ``na.drop``: the scan can push each down, and the optimiser need
    not reason about a single condition over all columns.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    tests = [F.col(c).isNotNull() for c in columns]
    tests += [~F.isnan(c) for c in columns if isinstance(types[c], (T.DoubleType, T.FloatType))]
    return reduce(and_, tests)


def derive(rows: DataFrame, *, complex_templates: Sequence[str] = ()) -> DataFrame:
    """Add ``provider``, the six head-room differences, ``gpu`` and ``complexity``."""
    return rows.withColumns(
        {
            "provider": feat.provider_key(F.col("provider_name"), F.col("region_name")),
            **feat.resource_diffs(),
            "gpu": F.col("gpus_requ"),
            "complexity": feat.complexity(F.col("template_name"), complex_templates),
        }
    )
