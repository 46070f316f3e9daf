"""Requests minus answers, as bags: every past answer cancels one request of its uuid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorage.settle import settle


def answer_counts(answers: DataFrame, *, uuid: str = "uuid") -> DataFrame:
    """Number of answers per uuid: ``(uuid, answered)``."""
    return answers.groupBy(uuid).agg(F.count(F.lit(1)).alias("answered"))


def last_cancelled(
    requests: DataFrame,
    answered: DataFrame,
    *,
    order: Sequence[str],
    uuid: str = "uuid",
    block: int = 1_000_000,
) -> DataFrame:
    """Per answered uuid, the position of the last request its answers cancel.

    Columns: ``uuid`` and ``cut``, a struct of the ``order`` columns.  ``order`` must tell requests of
    one uuid apart and start with a whole number such as the topic offset.

    Only (uuid, position) of answered uuids is looked at.  Positions are counted per block of
    ``block`` numbers first; rows are numbered only inside the one block per uuid where its answers
    run out.  So a uuid that a third of all requests share is never sorted in one task.
    """
    cell = F.floor(F.col(order[0]) / F.lit(block)).alias("_block")
    places = requests.select(uuid, *order, cell).join(answered, uuid)
    sizes = places.groupBy(uuid, "_block").agg(
        F.count(F.lit(1)).alias("_size"), F.max("answered").alias("answered")
    )
    earlier = Window.partitionBy(uuid).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Answers still unused when the block starts; the cut lies in the last block with some left.
    left = sizes.withColumn("_left", F.col("answered") - F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    last = (
        left.where(F.col("_left") > 0)
        .groupBy(uuid)
        .agg(F.max_by(F.struct("_block", "_size", "_left"), F.col("_block")).alias("_last"))
        .select(uuid, "_last.*")
        .withColumn("_take", F.least("_left", "_size"))
        .select(uuid, "_block", "_take")
    )
    within = Window.partitionBy(uuid, "_block").orderBy(*order)
    return (
        places.join(last, [uuid, "_block"])
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") == F.col("_take"))
        .select(uuid, F.struct(*order).alias("cut"))
    )


def skip_answered(
    requests: DataFrame,
    answers: DataFrame,
    *,
    order: Sequence[str] = ("offset", "partition"),
    uuid: str = "uuid",
    block: int = 1_000_000,
) -> DataFrame:
    """The requests no answer cancels; the earliest requests of a uuid are cancelled first."""
    cuts = last_cancelled(requests, answer_counts(answers, uuid=uuid), order=order, uuid=uuid, block=block)
    return after_cut(requests, cuts, order=order, uuid=uuid)


def after_cut(
    requests: DataFrame, cuts: DataFrame, *, order: Sequence[str], uuid: str = "uuid"
) -> DataFrame:
    """Requests behind their uuid's cut.  Settled, the cuts are broadcast when they are few."""
    cut = settle(cuts.select(uuid, "cut"))
    joined = requests.join(cut, uuid, "left")
    return joined.where(F.col("cut").isNull() | (F.struct(*order) > F.col("cut"))).select(*requests.columns)
