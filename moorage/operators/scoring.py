"""Success probability and expected duration of every candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.functions.scores import duration_goodness
from moorage.operators.models import class_probability
from moorage.operators.requests import MESSAGE
from moorage.schema import NO_PREDICTION, SUCCEEDED

def with_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the features ``rows`` lacks as NaN."""
    absent = {c: F.lit(float("nan")) for c in features if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def success_probability(rows: DataFrame, model: PipelineModel, *, to: str = "classification") -> DataFrame:
    """Probability of the 'succeeded' class from a fitted classifier pipeline."""
    answered = model.transform(rows)
    return answered.select(*rows.columns, class_probability(answered, SUCCEEDED).alias(to))


def expected_duration(rows: DataFrame, model: PipelineModel, *, to: str = "expected_time") -> DataFrame:
    return model.transform(rows).select(*rows.columns, F.col("prediction").alias(to))


def goodness(rows: DataFrame, *, expected: str = "expected_time", to: str = "regression") -> DataFrame:
    return rows.withColumn(
        to, duration_goodness(F.col(expected), F.col("min_success_time"), F.col("max_success_time"))
    )


def any_missing(features: Sequence[str]) -> Column:
    """Whether one of the features is null or NaN: a model has no answer for such a row."""
    tests = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features]
    missing = tests[0]
    for test in tests[1:]:
        missing = missing | test
    return missing


def void_messages(
    scored: DataFrame, missing: Column, *, column: str, message: str = MESSAGE
) -> DataFrame:
    """-1 for all candidates of a message as soon as one of them could not be scored."""
    spoiled = F.max(missing).over(Window.partitionBy(message))
    return scored.withColumn(column, F.when(spoiled, F.lit(NO_PREDICTION)).otherwise(F.col(column)))


def history_scores(enriched: DataFrame) -> DataFrame:
    """Scores without a fitted model: past success share, and the mean past success time."""
    return goodness(
        enriched.withColumns(
            {
                "classification": 1 - F.col("failure_percentage"),
                "expected_time": F.col("avg_success_time"),
            }
        )
    ).drop("expected_time")


def model_scores(
    enriched: DataFrame,
    *,
    classifier: PipelineModel | None,
    regressor: PipelineModel | None,
    class_features: Sequence[str] = (),
    duration_features: Sequence[str] = (),
    message: str = MESSAGE,
) -> DataFrame:
    """Both predictions for all candidates in one pass; a side without a model is -1 throughout."""
    rows = with_features(enriched, [*class_features, *duration_features])
    if classifier is None:
        rows = rows.withColumn("classification", F.lit(NO_PREDICTION))
    else:
        rows = success_probability(rows, classifier)
        rows = void_messages(rows, any_missing(class_features), column="classification", message=message)
    if regressor is None:
        rows = rows.withColumn("regression", F.lit(NO_PREDICTION))
    else:
        rows = goodness(expected_duration(rows, regressor)).drop("expected_time")
        rows = void_messages(rows, any_missing(duration_features), column="regression", message=message)
    return rows.select(*enriched.columns, "classification", "regression")
