"""Timestamps as whole microseconds, independent of the session's time zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Microseconds per unit.
MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def to_micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp, timestamp_ntz or date column of ``df``."""
    kind, col = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint") * F.lit(MICROS["day"])
    if not isinstance(kind, T.TimestampNTZType):
        raise TypeError(f"column {column!r} is {kind.simpleString()}, not a time")

    def part(value: Column, unit: str) -> Column:
        return value.cast("bigint") * F.lit(MICROS[unit])

    # unix_micros refuses zone-less timestamps, so the parts are added up instead.
    seconds = F.extract(F.lit("SECOND"), col).cast("decimal(8,6)")
    return (
        part(F.unix_date(col.cast("date")), "day")
        + part(F.hour(col), "hour")
        + part(F.minute(col), "minute")
        + (seconds * F.lit(MICROS["second"])).cast("bigint")
    )
