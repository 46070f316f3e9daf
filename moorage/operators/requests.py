"""Placement requests: routing by provider count, unfolding, duplicate providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorage.functions import features as feat
from moorage.operators.cleaning import derive
from moorage.schema import AS_SENT

#: Messages are told apart by where they stand in the source; a uuid may come twice.
MESSAGE = "msg_id"


def route(messages: DataFrame) -> DataFrame:
    """Add ``route``: 'none' (nothing to answer), 'single' (passed on unscored) or 'scored'."""
    count = F.coalesce(F.size("providers"), F.lit(0))
    return messages.withColumn(
        "route",
        F.when(count <= 0, F.lit("none")).when(count == 1, F.lit("single")).otherwise(F.lit("scored")),
    )


def unfold(messages: DataFrame, *, echo: Sequence[str] | None = None) -> DataFrame:
    """One row per (message, candidate): position, the request as sent, and its fields as columns.

    ``echo`` narrows the request as sent to the fields an answer is to carry; all by default.
    """
    rows = messages.select(
        *[c for c in messages.columns if c not in ("providers", "template_name")],
        # The template is one per message and joins every candidate row.
        F.col("template_name").alias("_template"),
        F.posexplode("providers").alias("_pos", "request"),
    )
    fields = [f.name for f in messages.schema["providers"].dataType.elementType.fields]
    return rows.select(
        *[c for c in rows.columns if c not in ("_pos", "request", "_template")],
        (F.col("_pos") + 1).alias("pos"),
        "request" if echo is None else F.struct(*[F.col(f"request.{f}").alias(f) for f in echo]).alias("request"),
        F.col("_template").alias("template_name"),
        *[F.col(f"request.{f}").alias(f) for f in fields if f not in ("template_name", "uuid", AS_SENT)],
    )


def describe(candidates: DataFrame, *, complex_templates: Sequence[str] = ()) -> DataFrame:
    """Features of each candidate that need no history."""
    return derive(candidates, complex_templates=complex_templates).transform(with_exactness)


def with_exactness(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn(
        "resource_exactness", feat.resource_exactness(F.col("exact_flavors"), F.col("n_instances_requ"))
    )


def merge_repeats(candidates: DataFrame, *, message: str = MESSAGE) -> DataFrame:
    """One row per (message, provider): place and request of the first mention, values of the last.

    The rows are first brought together by message: the windows here and the later ranking share
    that one shuffle, and Spark leaves it out where the rows came by message. One order tells the first mention and the last.
    """
    mention = Window.partitionBy(message, "provider").orderBy("pos")
    whole = mention.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {"_first_pos": F.first("pos").over(mention), "_last": F.row_number().over(mention) == F.count(F.lit(1)).over(whole)}
    if "request" in candidates.columns:
        first["_first_request"] = F.first("request").over(mention)
    merged = (
        candidates.repartition(message)
        .withColumns(first)
        .where("_last")
        .withColumn("pos", F.col("_first_pos"))
    )
    if "request" in candidates.columns:
        merged = merged.withColumn("request", F.col("_first_request"))
    return merged.select(*candidates.columns)
