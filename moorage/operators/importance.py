"""How much each feature counts in a fitted model."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.operators.closed_form import Line
from moorage.operators.models import CLASSIFIER, Fitted, class_probability
from moorage.operators.sampling import SEED, row_hash
from moorage.operators.scaling import scaled_name
from moorage.schema import SUCCEEDED

#: Rows of the background sample that stands for "feature unknown".
BACKGROUND_ROWS = 50
#: Features up to which all coalitions are visited; beyond them a sample is.
EXACT_FEATURES = 8
#: Sampled coalitions per feature, in groups whose spread tells the error.
_SAMPLED_PER_FEATURE, _GROUPS = 64, 8
#: Model answers that importances may cost unless a number of rows to explain is named.
MOST_ANSWERS = 500_000_000


def importance(fitted: Fitted, train: DataFrame, *, explained_rows: int | None = None) -> DataFrame:
    """(feature, importance), most important first.

    Trees report their own; linear models their coefficients (absolute for classifiers, signed
    for regressors); any other model the mean absolute Shapley value over the training rows, or
    over ``explained_rows`` of them. Every distinct row costs coalitions times background answers, so a number of rows must be
    named where all of them would cost more than ``MOST_ANSWERS``.
    """
    if train.isEmpty():
        raise ValueError("importances need training rows")
    values = own_importance(fitted)
    if values is None:
        explained = train if explained_rows is None else first_by_hash(train, explained_rows)
        if explained_rows is None:
            cost = train.count() * len(coalitions(len(fitted.features)).members) * BACKGROUND_ROWS
            if cost > MOST_ANSWERS:
                raise ValueError(f"explaining all training rows may cost {cost} model answers: name explained_rows")
        return shapley_importance(fitted, explained).select("feature", "importance")
    if len(values) != len(fitted.features):
        raise ValueError(f"{len(values)} importances for {len(fitted.features)} features")
    pairs = [(n, float(v)) for n, v in zip(fitted.features, values)]
    table = train.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.col("importance").desc())


def own_importance(fitted: Fitted) -> np.ndarray | None:
    if isinstance(fitted.formula, Line):
        return fitted.formula.weights
    model = fitted.model
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray()
    return None


def first_by_hash(df: DataFrame, rows: int, *, by: Sequence[str] | None = None) -> DataFrame:
    """A fixed sample: the first ``rows`` rows by hash, of the columns ``by`` or all."""
    return df.orderBy(row_hash(by or df.columns), *df.columns).limit(rows)


@dataclass(frozen=True)
class Coalitions:
    """Sets of features as bits, and for each estimate, feature and set the weight of the set's answer in the feature's value.

    The first estimate counts; those after it, if any, are of parts of the sample each.
    """

    members: np.ndarray
    weights: np.ndarray


def coalitions(width: int, *, exact: bool | None = None, seed: int = SEED) -> Coalitions:
    """All sets of ``width`` features, or, by default for more than ``EXACT_FEATURES``, a sample that all rows share.

    The sample pairs each random set with its complement; sizes follow the Shapley kernel. Weights are those of
    the least-squares fit of an additive game to the answers that gives the empty and the full set theirs: for an
    additive model it is exact with any sample, for others without bias to first order.
    """
    if exact if exact is not None else width <= EXACT_FEATURES:
        members = np.arange(2**width)
        size = np.bitwise_count(members).astype(int)
        share = [math.factorial(s) * math.factorial(width - s - 1) / math.factorial(width) for s in range(width)]
        joining, leaving = np.array([0.0, *share])[size], np.array([*share, 0.0])[size]
        return Coalitions(members, np.stack([np.where(members >> i & 1, joining, -leaving) for i in range(width)])[None])
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, width)
    kernel = 1.0 / (sizes * (width - sizes))
    pairs = _SAMPLED_PER_FEATURE * width // 2
    drawn = []
    for size in rng.choice(sizes, pairs, p=kernel / kernel.sum()).tolist():
        chosen = sum(1 << int(i) for i in rng.choice(width, size, replace=False))
        drawn += [chosen, (1 << width) - 1 - chosen]
    # The empty and the full set first, then the pairs.
    members = np.array([0, (1 << width) - 1, *drawn])
    group = np.repeat(np.arange(pairs) % _GROUPS, 2)
    parts = [np.ones(len(drawn), bool), *(group == g for g in range(_GROUPS))]
    return Coalitions(members, np.stack([_least_squares_weights(members, part, width) for part in parts]))


def _least_squares_weights(members: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """(features, sets): the fit over the sets of ``part``, which come after the empty and the full one."""
    inside = (members[2:][part, None] >> np.arange(width) & 1).astype(float)
    inverse = np.linalg.pinv(inside.T @ inside)
    free = np.zeros((width, len(members)))  # without the condition that values add up to the full set's answer
    free[:, 2:][:, part] = inverse @ inside.T
    free[:, 0] = -free[:, 2:].sum(axis=1)
    missing = -free.sum(axis=0)
    missing[1] += 1
    missing[0] -= 1
    return free + np.outer(inverse.sum(axis=1) / inverse.sum(), missing)


def shapley_values(
    fitted: Fitted,
    train: DataFrame,
    *,
    background: DataFrame | None = None,
    background_rows: int = BACKGROUND_ROWS,
    sets: Coalitions | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Shapley values of the model's answer for each distinct row of ``train``.

    Columns: ``x`` (features as the model sees them), ``n`` (rows that share them) and ``phi``: for each estimate of ``sets``
    an array of the features' values. The answer is the success probability of a classifier, or the value of a
    regressor. A feature left out of a coalition takes its values from the rows of ``background`` (by default the first
    of ``train`` by hash), averaged.

    Equal rows are explained once.  What is shuffled is one number per distinct row and coalition. A line's answers need neither
    a shuffle nor the background's rows one by one (:func:`_line_values`); with ``repeats`` its rows are not brought together, ``n`` is 1.
    """
    width = len(fitted.features)
    sets = sets or coalitions(width)

    def vectors(rows: DataFrame) -> DataFrame:
        last = len(fitted.pipeline.stages) - 1
        for stage in fitted.pipeline.stages[:last]:
            rows = stage.transform(rows)
        if fitted.formula is None:
            return rows.select(vector_to_array("features").alias("x"))
        names = [scaled_name(c) if last else c for c in fitted.features]
        return rows.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x"))

    seen = vectors(train)
    known = vectors(background) if background is not None else first_by_hash(seen, background_rows)
    if isinstance(fitted.formula, Line):
        counted = seen.withColumn("n", F.lit(1).cast("bigint")) if repeats else seen.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        return _line_values(fitted.formula, counted, known, sets)
    sample = [list(r["x"]) for r in known.collect()]
    others = F.array(*[F.array(*[F.lit(v) for v in row]) for row in sample])
    numbered = F.posexplode(_numbers(sets.members.tolist(), "bigint")).alias("place", "members")
    cases = seen.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x", "n", numbered)
    cases = cases.select("x", "n", "place", "members", F.explode(others).alias("other"))
    mixed = [F.when(F.getbit("members", F.lit(i)) == 1, F.col("x")[i]).otherwise(F.col("other")[i]) for i in range(width)]
    if fitted.formula is not None:
        answered, answer = cases, fitted.formula.answer(mixed)
    else:
        answered = fitted.model.transform(cases.select("x", "n", "place", array_to_vector(F.array(*mixed)).alias("features")))
        answer = class_probability(answered, SUCCEEDED) if fitted.kind == CLASSIFIER else F.col("prediction")

    # Averaged over the background first: a row's cases come from one task, which adds them up before its shuffle.
    valued = answered.select("x", "n", "place", answer.alias("answer")).groupBy("x", "n", "place").agg(F.avg("answer").alias("answer"))
    # The weights as one flat constant, estimate by estimate and feature by feature within each set.
    estimates = len(sets.weights)
    flat = _numbers(sets.weights.transpose(2, 0, 1).ravel().tolist(), "double")
    weight = F.slice(flat, F.col("place") * (estimates * width) + 1, estimates * width)
    weighed = valued.select("x", "n", "answer", weight.alias("w"))
    sums = [F.sum(F.col("answer") * F.col("w")[k]) for k in range(estimates * width)]
    rows = weighed.groupBy("x", "n").agg(F.array(*sums).alias("phi"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(estimates - 1)), lambda e: F.slice("phi", e * width + 1, width))
    return rows.select("x", "n", parts.alias("phi"))


def _line_values(line: Line, seen: DataFrame, known: DataFrame, sets: Coalitions) -> DataFrame:
    """``shapley_values`` of a linear function for rows (x, n), against all rows of ``known``.

    Its answer averaged over the background is its answer at the background's mean. With d for the weighted deviations from that mean, a
    coalition's answer is the mean's plus the d of its members; a value, a weighted sum over all coalitions, is then the same few sums
    over coalitions for every row, times d. So all coalitions and rows of any background cost one mean and one pass.
    """
    width = len(line.weights)
    mean = known.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean")).first()["mean"]
    if None in mean:
        mean, seen = [0.0] * width, seen.where(F.lit(False))
    inside = (sets.members[:, None] >> np.arange(width) & 1).astype(float)
    shares = sets.weights @ inside
    middle = sets.weights.sum(axis=2) * (line.intercept + float(np.dot(line.weights, mean)))
    apart = [(F.col("x")[i] - F.lit(m)) * F.lit(w) for i, (m, w) in enumerate(zip(mean, line.weights.tolist()))]
    away = seen.select("x", "n", F.array(*apart).alias("d"))

    def value(e: int, i: int) -> Column:
        return sum((F.col("d")[j] * F.lit(float(shares[e, i, j])) for j in range(width)), F.lit(float(middle[e, i])))

    phi = F.array(*[F.array(*[value(e, i) for i in range(width)]) for e in range(len(sets.weights))])
    return away.select("x", "n", phi.alias("phi"))


def _numbers(values: list, kind: str) -> Column:
    """A constant array that is one value of the plan, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def shapley_importance(fitted: Fitted, train: DataFrame, **how) -> DataFrame:
    """(feature, importance, standard_error): mean absolute Shapley value over the rows of ``train``.

    The standard error is that of sampling coalitions, from the spread of the parts of the sample; null where all
    coalitions were visited.
    """
    values = shapley_values(fitted, train, repeats=True, **how)
    sets = how.get("sets") or coalitions(len(fitted.features))
    estimates = len(sets.weights)

    def mean(e: int, i: int) -> Column:
        return F.sum(F.abs(F.col("phi")[e][i]) * F.col("n")) / F.sum("n")

    sums = values.agg(F.array(*[F.array(*[mean(e, i) for e in range(estimates)]) for i in range(len(fitted.features))]).alias("m")).first()["m"]
    rows = []
    for name, (value, *parts) in zip(fitted.features, sums or []):
        error = float(np.std(parts, ddof=1) / math.sqrt(len(parts))) if parts and None not in parts else None
        rows.append((name, value, error))
    table = train.sparkSession.createDataFrame(rows, "feature string, importance double, standard_error double")
    return table.orderBy(F.col("importance").desc())
