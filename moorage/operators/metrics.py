"""Quality measures of classifiers and regressors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.settle import settle

#: Distinct scores that one task puts in order.
_TASK_SCORES = 1_000_000


def _ratio(part: Column, whole: Column) -> Column:
    """A share; 0 when there is nothing to share."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _cells(label: str, predicted: str) -> list[Column]:
    y, y_hat = F.col(label) == 1, F.col(predicted) == 1
    return [
        F.count_if(y & y_hat).alias("tp"),
        F.count_if(~y & y_hat).alias("fp"),
        F.count_if(y & ~y_hat).alias("fn"),
        F.count_if(~y & ~y_hat).alias("tn"),
    ]


def classification_metrics(df: DataFrame, *, label: str = "y", predicted: str = "y_hat") -> DataFrame:
    """Accuracy, precision, recall and F1 of label 1, from one aggregation."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.agg(*_cells(label, predicted)).select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(df: DataFrame, *, label: str = "y", predicted: str = "y_hat") -> DataFrame:
    """All four (label, predicted) cells, empty ones included."""
    cells = df.agg(*_cells(label, predicted))
    entry = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("y"), F.lit(y_hat).alias("y_hat"), F.col(c).alias("n"))
            for y, y_hat, c in entry
        ]
    )
    return cells.select(F.inline(rows))


def class_report(df: DataFrame, *, label: str = "y", predicted: str = "y_hat") -> DataFrame:
    """Precision, recall, F1 and support per class, with their plain and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def measures(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        ]

    of_class = df.agg(*_cells(label, predicted)).select(
        F.struct(F.lit("0").alias("class"), *measures(tn, fn, fp)).alias("zero"),
        F.struct(F.lit("1").alias("class"), *measures(tp, fp, fn)).alias("one"),
    )
    total = F.col("zero.support") + F.col("one.support")

    def mean(name: str, weights: tuple[Column, Column]) -> Column:
        pair = [F.col(f"{c}.{name}") * w for c, w in zip(("zero", "one"), weights)]
        return (pair[0] + pair[1]).alias(name)

    def summary(name: str, weights: tuple[Column, Column]) -> Column:
        means = [mean(c, weights) for c in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("class"), *means, total.alias("support"))

    half = (F.lit(0.5), F.lit(0.5))
    by_support = (_ratio(F.col("zero.support"), total), _ratio(F.col("one.support"), total))
    rows = F.array(F.col("zero"), F.col("one"), summary("macro avg", half), summary("weighted avg", by_support))
    return of_class.select(F.inline(rows))


def regression_metrics(df: DataFrame, *, label: str = "y", predicted: str = "y_hat", by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae and r2, of each group of ``by``; r2 is null when the label is constant."""
    error = F.col(label) - F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(F.col(label)).alias("spread"),
    )
    return sums.select(
        *by,
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2"),
    )


def roc_auc(df: DataFrame, *, label: str = "y", score: str = "score", task_scores: int = _TASK_SCORES) -> DataFrame:
    """Area under the ROC curve, exact with ties: the share of (1, 0) pairs in the right order.

    Rows are pre-aggregated per distinct score and settled, so ``df`` is read once. The running count of zeros has two levels:
    inside ranges of about ``task_scores`` distinct scores each, and over the ranges, so the global order never
    passes through one task.  Null when a class is missing.
    """
    per_score = settle(
        df.groupBy(F.col(score).cast("double").alias("score")).agg(
            F.count_if(F.col(label) == 1).cast("double").alias("ones"),
            F.count_if(F.col(label) == 0).cast("double").alias("zeros"),
        )
    )
    ranges = max(1, -(-per_score.count() // task_scores))
    placed = per_score.repartitionByRange(ranges, "score").withColumn("part", F.spark_partition_id())
    if ranges > 1:
        placed = settle(placed)  # range ends come from a sample: they must hold for both levels
    within = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    # Pairs won inside the range; each 1 also wins against all zeros of earlier ranges.
    wins = placed.withColumn("below", F.sum("zeros").over(within) - F.col("zeros") / 2)
    per_part = wins.groupBy("part").agg(
        F.sum("ones").alias("ones"),
        F.sum("zeros").alias("zeros"),
        F.sum(F.col("ones") * F.col("below")).alias("won"),
    )
    # One row per range from here on.
    before = F.coalesce(F.sum("zeros").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = per_part.withColumn("won", F.col("won") + F.col("ones") * before)
    sums = total.agg(F.sum("won").alias("won"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    return sums.select(F.try_divide(F.col("won"), F.col("ones") * F.col("zeros")).alias("auc"))
