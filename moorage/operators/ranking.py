"""Weighting, filtering, ordering and folding of scored candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorage.functions.scores import number_or_null
from moorage.operators.requests import MESSAGE
from moorage.schema import NO_PREDICTION, SCORE_FIELDS


@dataclass(frozen=True)
class RankSpec:
    """How scores become an order.

    ``weight`` is the share of the success probability, the rest is the duration's.  ``threshold``
    (off when None) is the least total kept.  ``exact_first`` puts the better resource match ahead
    of any score.
    """

    weight: float = 0.75
    threshold: float | None = None
    exact_first: bool = True

    def __post_init__(self):
        if not 0 < self.weight < 1:
            raise ValueError("weight must lie between 0 and 1")


def weigh(scored: DataFrame, spec: RankSpec = RankSpec()) -> DataFrame:
    return scored.withColumns(
        {
            "classification": F.col("classification") * F.lit(spec.weight),
            "regression": F.col("regression") * F.lit(1 - spec.weight),
        }
    )


def with_rank(scored: DataFrame, spec: RankSpec = RankSpec(), *, message: str = MESSAGE) -> DataFrame:
    """Weighted scores, ``kept`` (passes the threshold) and ``rank`` among the kept of a message.

    Equal candidates keep the order of the request.  A candidate whose total is null or NaN does not
    pass a threshold, and comes after those that have a total and the same precedence.  A message is
    one source record, so its window is bounded by the record.
    """
    total = number_or_null(F.col("classification") + F.col("regression"))
    kept = F.lit(True) if spec.threshold is None else F.coalesce(total >= F.lit(spec.threshold), F.lit(False))
    order = [F.col("kept").desc()]
    if spec.exact_first:
        order.append(number_or_null(F.col("resource_exactness")).desc_nulls_last())
    order += [total.desc_nulls_last(), F.col("pos").asc()]
    place = F.row_number().over(Window.partitionBy(message).orderBy(*order))
    return weigh(scored, spec).withColumn("kept", kept).withColumn("rank", F.when(F.col("kept"), place))


def rank_candidates(scored: DataFrame, spec: RankSpec = RankSpec(), *, message: str = MESSAGE) -> DataFrame:
    """Flat ranking: the kept candidates of every message with their ``rank``."""
    return with_rank(scored, spec, message=message).where("kept").drop("kept")


def merged_fields(request_fields: list[str]) -> list:
    """Score fields and request fields of one entry; the request wins where names clash."""
    scores = [F.col(c) for c in SCORE_FIELDS if c not in request_fields]
    return scores + [F.col(f"request.{c}").alias(c) for c in request_fields]


def fold_messages(ranked: DataFrame, *, message: str = MESSAGE) -> DataFrame:
    """One row per message: ``uuid`` and ``ranked_providers`` in rank order.

    Takes the output of ``with_rank``, dropped candidates included: a message all of whose
    candidates were dropped still answers, with an empty list.
    """
    request_fields = ranked.schema["request"].dataType.fieldNames()
    entry = F.struct("rank", F.struct(*merged_fields(request_fields)).alias("entry"))
    folded = ranked.groupBy(message).agg(
        F.first("uuid").alias("uuid"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), entry))).alias("_entries"),
    )
    return folded.select(message, "uuid", F.col("_entries.entry").alias("ranked_providers"))


def pass_lone(ranked: DataFrame) -> DataFrame:
    """The only candidate of a message (``route`` 'single') passes with 'no prediction' scores."""
    lone = F.col("route") == "single"
    none = F.lit(NO_PREDICTION)
    return ranked.withColumns(
        {
            "classification": F.when(lone, none).otherwise(F.col("classification")),
            "regression": F.when(lone, none).otherwise(F.col("regression")),
            "kept": lone | F.col("kept"),
            "rank": F.when(lone, F.lit(1)).otherwise(F.col("rank")),
        }
    )
