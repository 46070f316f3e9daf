"""Learners that follow from a few sums over the rows: Gaussian naive Bayes and least squares.

The sums are counts, means and co-moments, which Spark computes in a few aggregations without cancellation and which
merge. Kept per group of rows, a fold say, they give the model of any union of groups without another read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.operators.scaling import Scaler


@dataclass(frozen=True)
class Moments:
    """Rows, means, and sums of products of the deviations from them; empty where nothing was seen."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        return Moments(n, mean, self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def scaled(self, middles: np.ndarray, spreads: np.ndarray) -> Moments:
        """Those of the columns less ``middles`` and divided by ``spreads``."""
        return Moments(self.n, (self.mean - middles) / spreads, self.products / np.outer(spreads, spreads))


#: Sums of one aggregation: Spark does not compile one of over a hundred numbers (``spark.sql.codegen.maxFields``).
_SUMS = 91


def moments(rows: DataFrame, columns: Sequence[str], by: Sequence[str], *, crossed: bool) -> dict[tuple, Moments]:
    """Values of ``by`` (few) -> moments of the columns; ``crossed``: of pairs of columns too.

    Two passes: the means of each group, then plain sums of products of the deviations from them, ``_SUMS`` at a time. Those run as compiled
    code, which as many of Spark's covariances, each with four numbers of its own, do not.
    """
    width = len(columns)
    pairs = [(i, j) for i in range(width) for j in range(i if crossed else i, width if crossed else i + 1)]
    numbers = rows.select(*[F.col(c).alias(f"by{k}") for k, c in enumerate(by)], *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    keys = [f"by{k}" for k in range(len(by))]

    def refused_unless(whole: bool) -> None:
        if not whole:
            raise ValueError(f"a column of {list(columns)} has no value, or NaN or infinite ones")

    averages = numbers.groupBy(*keys).agg(F.array(F.count(F.lit(1)), *[F.count(f"x{i}") for i in range(width)]).alias("n"), F.array(*[F.avg(f"x{i}") for i in range(width)]).alias("mean"))
    counts, centres = {}, {}
    for r in averages.collect():
        refused_unless(min(r["n"]) == max(r["n"]) and all(v is not None and math.isfinite(v) for v in r["mean"]))
        key = tuple(r[k] for k in keys)
        counts[key], centres[key] = r["n"][0], r["mean"]
    if not centres:
        return {}
    centre = F.lit(None).cast("array<double>")
    for key, mean in centres.items():
        here = reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, key)], F.lit(True))
        centre = F.when(here, F.array(*map(F.lit, mean))).otherwise(centre)
    apart = numbers.withColumn("centre", centre).select(*keys, *[(F.col(f"x{i}") - F.col("centre")[i]).alias(f"x{i}") for i in range(width)])
    products = {key: np.zeros((width, width)) for key in centres}
    for at in range(0, len(pairs), _SUMS):
        some = pairs[at : at + _SUMS]
        # One array a group, so that Spark returns numbers, not a hundred columns.
        for r in apart.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in some]).alias("product")).collect():
            key = tuple(r[k] for k in keys)
            refused_unless(all(math.isfinite(v) for v in r["product"]))
            for (i, j), value in zip(some, r["product"]):
                products[key][i, j] = products[key][j, i] = value
    return {key: Moments(counts[key], np.array(centres[key]), products[key]) for key in centres}


@dataclass(frozen=True)
class Line:
    """A fitted linear function."""

    intercept: float
    weights: np.ndarray

    def answer(self, values: Sequence[Column]) -> Column:
        """The value: what importances explain."""
        return reduce(lambda total, pair: total + _number(pair[0]) * pair[1], zip(self.weights.tolist(), values), _number(self.intercept))

    score = answer

    def stage(self, names: Sequence[str]) -> SQLTransformer:
        terms = [_text(self.intercept), *(f"{_text(w)} * `{c}`" for w, c in zip(self.weights.tolist(), names))]
        return SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS prediction FROM __THIS__")


@dataclass(frozen=True)
class Bayes:
    """Log-odds of class 0 against class 1: a constant and, for each feature, both classes' means and variances."""

    constant: float
    means: np.ndarray
    variances: np.ndarray

    def _odds(self, values: Sequence[Any], text: Callable[[float], Any]) -> list:
        out = []
        for k, x in enumerate(values):
            (m0, v0), (m1, v1) = ((float(self.means[c, k]), float(self.variances[c, k])) for c in (0, 1))
            out.append((x, text(m0), text(v0), text(m1), text(v1)))
        return out

    def odds(self, values: Sequence[Column]) -> Column:
        parts = [(x - m1) * (x - m1) / v1 - (x - m0) * (x - m0) / v0 for x, m0, v0, m1, v1 in self._odds(values, _number)]
        return _number(self.constant) + 0.5 * reduce(lambda a, b: a + b, parts)

    def answer(self, values: Sequence[Column]) -> Column:
        """Probability of class 0: what importances explain."""
        return 1 / (1 + F.exp(-self.odds(values)))

    def score(self, values: Sequence[Column]) -> Column:
        """Probability of class 1."""
        return 1 / (1 + F.exp(self.odds(values)))

    def stage(self, names: Sequence[str]) -> SQLTransformer:
        columns = [f"`{c}`" for c in names]
        parts = [f"(({x} - {m1}) * ({x} - {m1}) / {v1} - ({x} - {m0}) * ({x} - {m0}) / {v0})" for x, m0, v0, m1, v1 in self._odds(columns, _text)]
        odds = f"SELECT *, {_text(self.constant)} + 0.5D * ({' + '.join(parts)}) AS `log odds` FROM __THIS__"
        return SQLTransformer(
            statement=f"SELECT * EXCEPT (`log odds`), array(1 / (1 + exp(-`log odds`)), 1 / (1 + exp(`log odds`))) AS probability, "
            f"CASE WHEN `log odds` < 0 THEN 1.0D ELSE 0.0D END AS prediction FROM ({odds})"
        )


def _number(value: float) -> Column:
    return F.lit(float(value))


def _text(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def least_squares(known: Moments, *, alpha: float = 0.0, fit_intercept: bool = True) -> Line:
    """The line through the moments of the features and, last, the target; ``alpha`` times its squared weights is added to the loss.

    A feature that does not vary, or only with others, gets the least weight that fits as well.
    """
    products, mean = known.products, known.mean
    if not fit_intercept:
        products = products + known.n * np.outer(mean, mean)
    features, target = products[:-1, :-1] + alpha * np.eye(len(mean) - 1), products[:-1, -1]
    # On a common scale, so that rounding is judged alike in every direction.
    size = np.sqrt(np.diag(features))
    size = np.where(size > 0, size, 1.0)
    weights = np.linalg.lstsq(features / np.outer(size, size), target / size, rcond=1e-13)[0] / size
    return Line(float(mean[-1] - mean[:-1] @ weights) if fit_intercept else 0.0, weights)


def naive_bayes(classes: dict[int, Moments], *, var_smoothing: float = 1e-9) -> Bayes:
    """From the moments of the classes 0 and 1. A class without rows is never predicted."""
    every = reduce(lambda a, b: a + b, classes.values())
    floor = var_smoothing * float((np.diag(every.products) / every.n).max())
    if len(classes) == 1:
        only, width = next(iter(classes)), len(every.mean)
        return Bayes(math.inf if only == 0 else -math.inf, np.zeros((2, width)), np.ones((2, width)))
    means = np.stack([classes[c].mean for c in (0, 1)])
    variances = np.stack([np.diag(classes[c].products) / classes[c].n for c in (0, 1)]) + floor
    if not (variances > 0).all():
        raise ValueError("no feature varies")
    constant = math.log(classes[0].n / classes[1].n) - 0.5 * float(np.log(variances[0]).sum() - np.log(variances[1]).sum())
    return Bayes(constant, means, variances)


Formula = Line | Bayes


@dataclass(frozen=True)
class ClosedForm:
    """A learner's customary parameters with their defaults, whether it tells classes apart, and what makes its model of the sums."""

    defaults: dict[str, Any]
    classifies: bool
    solve: Callable[..., Formula]

    def check(self, name: str, params: dict) -> None:
        for given in params:
            if given not in self.defaults:
                raise ValueError(f"model {name!r} has no parameter {given!r}; known: {sorted(self.defaults)}")

    def sums(self, rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> dict[tuple, Moments]:
        """Group (values of ``by``, then the class of a classifier) -> moments. ``rows`` are read twice."""
        if self.classifies:
            return moments(rows.withColumn(label, F.col(label).cast("int")), features, [*by, label], crossed=False)
        return moments(rows, [*features, label], list(by), crossed=True)

    def solved(self, parts: Iterable[tuple[tuple, Moments]], params: dict) -> Formula:
        """The model of the rows of several groups."""
        settings = {**self.defaults, **params}
        if not self.classifies:
            return self.solve(reduce(lambda a, b: a + b, (m for _, m in parts)), **settings)
        classes: dict[int, Moments] = {}
        for key, part in parts:
            if key[-1] not in (0, 1):
                raise ValueError(f"label {key[-1]!r} is neither 0 nor 1")
            classes[key[-1]] = classes[key[-1]] + part if key[-1] in classes else part
        return self.solve(classes, **settings)


# Estimator names and the defaults users of those names expect.
CLOSED_FORMS: dict[str, ClosedForm] = {
    "GaussianNB": ClosedForm({"var_smoothing": 1e-9}, True, naive_bayes),
    "LinearRegression": ClosedForm({"fit_intercept": True}, False, least_squares),
    "Ridge": ClosedForm({"alpha": 1.0, "fit_intercept": True}, False, least_squares),
}


def scaled_moments(known: Moments, scaler: Scaler | None, columns: Sequence[str]) -> Moments:
    """Moments of scaled columns from those of the plain ones; columns that the scaler lacks stay."""
    if scaler is None:
        return known
    pairs = [scaler.get(c, (0.0, 1.0)) for c in columns]
    return known.scaled(np.array([m for m, _ in pairs]), np.array([s for _, s in pairs]))
