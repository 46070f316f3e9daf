"""Robust scaling: centred on the median, divided by the inter-quartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.operators.quantiles import exact_quantiles

Scaler = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: Sequence[str], **search) -> Scaler:
    """Column -> (median, range); a column without spread keeps range 1."""
    scaler = {}
    for name, (low, middle, high) in exact_quantiles(df, columns, [0.25, 0.5, 0.75], **search).items():
        if middle is None:
            raise ValueError(f"column {name!r} has no value to scale by")
        scaler[name] = (middle, (high - low) or 1.0)
    return scaler


def scaled(name: str, scaler: Scaler) -> Column:
    middle, spread = scaler[name]
    return (F.col(name) - F.lit(middle)) / F.lit(spread)


def robust_scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({name: scaled(name, scaler) for name in scaler})


def scaled_name(name: str) -> str:
    return f"{name}__scaled"


def scaler_stage(scaler: Scaler) -> SQLTransformer:
    """The fitted scaler as a pipeline stage, so that it is saved and loaded with the model."""
    columns = [
        f"(`{name}` - CAST('{middle!r}' AS DOUBLE)) / CAST('{spread!r}' AS DOUBLE) AS `{scaled_name(name)}`"
        for name, (middle, spread) in scaler.items()
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")
