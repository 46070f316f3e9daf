"""Column expressions that turn a raw message into features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorage.schema import OUTCOMES, RESOURCE_DIFFS


def outcome(status: Column) -> Column:
    """Class label of a status text; null when the text names no final outcome."""
    label = F.lit(None).cast("int")
    for text, value in OUTCOMES.items():
        label = F.when(status == text, F.lit(value)).otherwise(label)
    return label


def parsed_time(text: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp without zone from ISO text, or from the first of ``formats`` that fits; else null.

    Text with an offset (or ``Z``) names an instant and becomes its UTC time; text without one stays as written.
    """
    # Most texts are dates or end in digits alone: only those with a time of day go through an expression.
    timed = F.contains(text, F.lit(":")) | F.contains(text, F.lit("T")) | F.contains(text, F.lit("t"))
    with_offset = timed & text.rlike(r"(?i)[0-9](z|utc|gmt|[+-][0-9]{1,2}(:?[0-9]{2})?)\s*$") & text.rlike("[0-9]:[0-9]|[Tt][0-9]")
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    tries = [F.when(with_offset, instant).otherwise(text.try_cast("timestamp_ntz"))]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def deployment_time(completion: Column, failed_time: Column, failures: Column) -> Column:
    """Completion time, or mean time per failed attempt when the deployment never completed."""
    return F.when(completion != 0, completion).otherwise(F.try_divide(failed_time, failures.cast("double")))


def provider_key(name: Column, region: Column) -> Column:
    return F.concat(name, F.lit("-"), region)


def resource_diff(prefix: str) -> Column:
    """Head-room left once the request is granted."""
    return F.col(f"{prefix}_quota") - F.col(f"{prefix}_usage") - F.col(f"{prefix}_requ")


def resource_diffs() -> dict[str, Column]:
    return {name: resource_diff(prefix) for name, prefix in RESOURCE_DIFFS.items()}


def complexity(template: Column, complex_templates: Sequence[str]) -> Column:
    if not complex_templates:
        return F.lit(0)
    return F.coalesce(template.isin(list(complex_templates)).cast("int"), F.lit(0))


def resource_exactness(exact: Column, instances: Column) -> Column:
    """Share of requested instances the provider can serve with an exactly matching flavour.

    0 where no instances are asked for; NaN counts as none, although Spark holds it above any number.
    """
    return F.when((instances > 0) & ~F.isnan(instances), exact / instances).otherwise(F.lit(0.0))
