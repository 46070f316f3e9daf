"""Learners by name: choosing, fitting and comparing Spark ML estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from moorage.operators import metrics
from moorage.operators.closed_form import CLOSED_FORMS, ClosedForm, Formula, scaled_moments
from moorage.operators.sampling import SEED, with_folds
from moorage.operators.scaling import Scaler, fit_scaler, scaled, scaled_name, scaler_stage
from moorage.settle import settle

CLASSIFIER, REGRESSOR = "classifier", "regressor"

# The deepest tree Spark grows stands for "no limit".
_DEEPEST = 30


@dataclass(frozen=True)
class Learner:
    """How a well-known estimator name maps to a Spark ML class.

    ``renamed`` maps the usual parameter names to Spark's; ``fixed`` are starting values that give
    the customary defaults; ``derived`` computes Spark parameters that need the training size, from the parameters
    in ``derived_from``.
    """

    kind: str
    make: type
    renamed: dict[str, str] = field(default_factory=dict)
    fixed: dict[str, Any] = field(default_factory=dict)
    derived: Callable[[dict, int, int], dict] | None = None
    derived_from: tuple[str, ...] = ()


def _depth(value) -> int:
    """Spark's trees end at depth 30; no limit means that one, and a deeper limit is refused."""
    if value is not None and int(value) > _DEEPEST:
        raise ValueError(f"max_depth {value} is above the deepest tree, {_DEEPEST}")
    return _DEEPEST if value is None else int(value)


def recorded_params(name: str, params: dict, kind: str) -> dict:
    """The given parameters with the depth that is really used, for the registry."""
    entry = learner(name, kind)
    if isinstance(entry, ClosedForm):
        return {**entry.defaults, **params}
    deep = entry.renamed.get("max_depth") == "maxDepth"
    return {**params, "max_depth": _depth(params["max_depth"])} if deep and "max_depth" in params else dict(params)


# Parameter names shared by families of estimators -> Spark's names.
_TREE = {
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "min_impurity_decrease": "minInfoGain",
    "random_state": "seed",
    "max_bins": "maxBins",
}
_CRITERION = {"criterion": "impurity"}
_FOREST = {**_TREE, "n_estimators": "numTrees", "max_features": "featureSubsetStrategy"}
_BOOSTING = {**_TREE, "n_estimators": "maxIter", "learning_rate": "stepSize", "subsample": "subsamplingRate"}
_LINEAR = {"fit_intercept": "fitIntercept", "max_iter": "maxIter", "tol": "tol"}


def _inverse_strength(given: dict, rows: int, width: int) -> dict:
    """A penalty divided by C and summed over rows, as Spark's penalty on the mean loss."""
    penalty = given.get("penalty", "l2")
    if penalty is None:
        return {"regParam": 0.0}
    if (penalty == "elasticnet") != (given.get("l1_ratio") is not None):
        raise ValueError("penalty 'elasticnet' needs l1_ratio, and no other penalty takes it")
    shares = {"l2": 0.0, "l1": 1.0, "elasticnet": given.get("l1_ratio")}
    if penalty not in shares:
        raise ValueError(f"penalty {penalty!r} is not known; known: {sorted(shares)} and None")
    return {"regParam": 1.0 / (float(given.get("C", 1.0)) * rows), "elasticNetParam": float(shares[penalty])}


def _lasso_strength(given: dict, rows: int, width: int) -> dict:
    return {"regParam": float(given.get("alpha", 1.0)), "elasticNetParam": 1.0}


def _elastic_strength(given: dict, rows: int, width: int) -> dict:
    return {
        "regParam": float(given.get("alpha", 1.0)),
        "elasticNetParam": float(given.get("l1_ratio", 0.5)),
    }


def _glm_strength(given: dict, rows: int, width: int) -> dict:
    return {"regParam": float(given.get("alpha", 1.0))}


def _tweedie(given: dict, rows: int, width: int) -> dict:
    return {**_glm_strength(given, rows, width), "variancePower": float(given.get("power", 0.0))}


def _layers(given: dict, rows: int, width: int) -> dict:
    hidden = given.get("hidden_layer_sizes", (100,))
    hidden = [hidden] if isinstance(hidden, int) else list(hidden)
    return {"layers": [width, *hidden, 2]}


# Estimator names, with the defaults users of those names expect.
LEARNERS: dict[str, Learner] = {
    "RandomForestClassifier": Learner(
        CLASSIFIER,
        C.RandomForestClassifier,
        {**_FOREST, **_CRITERION},
        {"numTrees": 100, "maxDepth": _DEEPEST, "featureSubsetStrategy": "sqrt"},
    ),
    "DecisionTreeClassifier": Learner(
        CLASSIFIER, C.DecisionTreeClassifier, {**_TREE, **_CRITERION}, {"maxDepth": _DEEPEST}
    ),
    "GradientBoostingClassifier": Learner(
        CLASSIFIER, C.GBTClassifier, _BOOSTING, {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
    ),
    "LogisticRegression": Learner(
        CLASSIFIER,
        C.LogisticRegression,
        _LINEAR,
        {"maxIter": 100, "standardization": False},
        _inverse_strength,
        ("C", "penalty", "l1_ratio"),
    ),
    "MultinomialNB": Learner(
        CLASSIFIER, C.NaiveBayes, {"alpha": "smoothing"}, {"modelType": "multinomial", "smoothing": 1.0}
    ),
    "MLPClassifier": Learner(
        CLASSIFIER,
        C.MultilayerPerceptronClassifier,
        {"max_iter": "maxIter", "tol": "tol", "random_state": "seed", "learning_rate_init": "stepSize"},
        {"maxIter": 200},
        _layers,
        ("hidden_layer_sizes",),
    ),
    "RandomForestRegressor": Learner(
        REGRESSOR,
        R.RandomForestRegressor,
        _FOREST,
        {"numTrees": 100, "maxDepth": _DEEPEST, "featureSubsetStrategy": "all"},
    ),
    "DecisionTreeRegressor": Learner(REGRESSOR, R.DecisionTreeRegressor, _TREE, {"maxDepth": _DEEPEST}),
    "GradientBoostingRegressor": Learner(
        REGRESSOR, R.GBTRegressor, _BOOSTING, {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
    ),
    "Lasso": Learner(REGRESSOR, R.LinearRegression, _LINEAR, {"standardization": False}, _lasso_strength, ("alpha",)),
    "ElasticNet": Learner(
        REGRESSOR, R.LinearRegression, _LINEAR, {"standardization": False}, _elastic_strength, ("alpha", "l1_ratio")
    ),
    "PoissonRegressor": Learner(
        REGRESSOR,
        R.GeneralizedLinearRegression,
        _LINEAR,
        {"family": "poisson", "link": "log"},
        _glm_strength,
        ("alpha",),
    ),
    "GammaRegressor": Learner(
        REGRESSOR,
        R.GeneralizedLinearRegression,
        _LINEAR,
        {"family": "gamma", "link": "log"},
        _glm_strength,
        ("alpha",),
    ),
    "TweedieRegressor": Learner(
        REGRESSOR, R.GeneralizedLinearRegression, _LINEAR, {"family": "tweedie"}, _tweedie, ("alpha", "power")
    ),
    "IsotonicRegression": Learner(REGRESSOR, R.IsotonicRegression, {"increasing": "isotonic"}),
}
_NO_PROBABILITY = ["LinearSVC"]


def known_names() -> list[str]:
    return sorted([*LEARNERS, *CLOSED_FORMS])


def learner(name: str, kind: str) -> Learner | ClosedForm:
    """Look a learner up, with a clear error for unknown names, the wrong kind, or no probabilities."""
    if name in CLOSED_FORMS:
        if CLOSED_FORMS[name].classifies != (kind == CLASSIFIER):
            raise TypeError(f"model {name!r} is not a {kind}")
        return CLOSED_FORMS[name]
    if name in _NO_PROBABILITY:
        raise ValueError(f"{name} gives no class probability, which scoring and AUC need")
    if name not in LEARNERS:
        raise ValueError(f"model {name!r} not found; known: {known_names()}")
    if LEARNERS[name].kind != kind:
        raise TypeError(f"model {name!r} is not a {kind}")
    return LEARNERS[name]


def estimator(name: str, params: dict, *, kind: str, label: str, rows: int, width: int):
    """A Spark estimator for ``name`` with the given parameters, under either naming; other learners' are refused."""
    entry = learner(name, kind)
    if name == "IsotonicRegression" and width != 1:
        raise ValueError(f"IsotonicRegression takes exactly one feature, not {width}")
    settings = dict(entry.fixed)
    if entry.derived is not None:
        settings.update(entry.derived(params, rows, width))
    stage = entry.make(featuresCol="features", labelCol=label)
    if stage.hasParam("seed"):
        settings["seed"] = SEED
    for given, value in params.items():
        if given in entry.derived_from:
            continue
        spark_name = entry.renamed.get(given, given)
        if not stage.hasParam(spark_name):
            raise ValueError(f"model {name!r} has no parameter {given!r}")
        if spark_name == "maxDepth":
            value = _depth(value)
        if spark_name == "featureSubsetStrategy":
            value = "all" if value in (None, 1.0) else str(value)
        settings[spark_name] = value
    for spark_name, value in settings.items():
        param = stage.getParam(spark_name)
        stage.set(param, param.typeConverter(value))
    return stage


@dataclass
class Fitted:
    """A fitted pipeline with what is needed to describe and reuse it."""

    name: str
    kind: str
    params: dict
    features: list[str]
    label: str
    pipeline: PipelineModel
    #: Of a closed-form learner: the function of the features that the pipeline's last stage computes.
    formula: Formula | None = None

    @property
    def model(self):
        return self.pipeline.stages[-1]

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(rows)


def feature_stages(train: DataFrame, features: Sequence[str], *, scale: bool) -> list:
    """Optional scaler fitted on ``train``, then the features as one vector in training order."""
    if not scale:
        return [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    names = [scaled_name(c) for c in features]
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return [scaler_stage(fit_scaler(train, features)), assembler]


@dataclass(frozen=True)
class Sums:
    """What closed-form learners of one kind need of the training rows, whatever their parameters."""

    moments: dict
    scaler: Scaler | None


def training_sums(train: DataFrame, *, name: str, kind: str, features: Sequence[str], label: str, scale: bool = False) -> Sums:
    """The sums that ``fit`` takes, for models of several parameters from one set of reads."""
    entry = learner(name, kind)
    if not isinstance(entry, ClosedForm):
        raise TypeError(f"model {name!r} does not follow from sums")
    return Sums(entry.sums(train, features, label), fit_scaler(train, features) if scale else None)


def fit(
    train: DataFrame,
    *,
    name: str,
    params: dict,
    kind: str,
    features: Sequence[str],
    label: str,
    scale: bool = False,
    stages: list | None = None,
    sums: Sums | None = None,
) -> Fitted:
    """A learner fitted on ``train``; ``sums`` are those of the same rows, features and scaling, if they are known."""
    entry = learner(name, kind)
    if isinstance(entry, ClosedForm):
        entry.check(name, params)
        sums = sums or training_sums(train, name=name, kind=kind, features=features, label=label, scale=scale)
        scaler = sums.scaler
        formula = entry.solved(_scaled(sums.moments, scaler, features), params)
        names = [scaled_name(c) for c in features] if scale else list(features)
        pipeline = PipelineModel([*([scaler_stage(scaler)] if scale else []), formula.stage(names)])
        return Fitted(name, kind, recorded_params(name, params, kind), list(features), label, pipeline, formula)
    stages = stages or feature_stages(train, features, scale=scale)
    # Only penalties that are spread over the rows need their number.
    rows = max(train.count(), 1) if entry.derived else 0
    stage = estimator(name, params, kind=kind, label=label, rows=rows, width=len(list(features)))
    pipeline = Pipeline(stages=[*stages, stage]).fit(train)
    return Fitted(name, kind, recorded_params(name, params, kind), list(features), label, pipeline)


def _scaled(known: dict, scaler: Scaler | None, columns: Sequence[str]) -> list:
    """Groups with the moments of scaled features; a target after them stays as it is."""
    return [(key, scaled_moments(m, scaler, [*columns, *[""] * (len(m.mean) - len(columns))])) for key, m in known.items()]


def predictions(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """``y``, ``y_hat`` and, for classifiers, ``score`` = probability of label 1."""
    out = fitted.predict(rows)
    columns = [F.col(fitted.label).alias("y"), F.col("prediction").alias("y_hat")]
    if fitted.kind == CLASSIFIER:
        columns.append(class_probability(out, 1).alias("score"))
    return out.select(*columns)


def class_probability(answered: DataFrame, which: int) -> Column:
    """Probability of a class in a model's answers: Spark's are vectors, closed forms' arrays."""
    plain = isinstance(answered.schema["probability"].dataType, ArrayType)
    return (F.col("probability") if plain else vector_to_array("probability"))[which]


def evaluate(fitted: Fitted, rows: DataFrame) -> dict[str, float | None]:
    """Metric name -> value.

    The predictions, two or three numbers a row, are settled: the model runs once per row however
    many measures read them.
    """
    scored = settle(predictions(fitted, rows))
    if fitted.kind == REGRESSOR:
        return metrics.regression_metrics(scored).first().asDict()
    values = metrics.classification_metrics(scored).first().asDict()
    return {**values, "auc": metrics.roc_auc(scored).first()["auc"]}


def train_and_test_metrics(fitted: Fitted, train: DataFrame, test: DataFrame) -> dict[str, float | None]:
    both = {"train": train, "test": test}
    return {f"{m}_{part}": v for part, rows in both.items() for m, v in evaluate(fitted, rows).items()}


@dataclass(frozen=True)
class FoldScore:
    name: str
    fold: int
    score: float | None


def cross_validate(
    train: DataFrame,
    models: dict[str, dict],
    *,
    kind: str,
    features: Sequence[str],
    label: str,
    folds: int = 5,
    by: str | None = None,
    scale: bool = False,
    scale_inside_fold: bool = False,
    stored: bool = False,
) -> list[FoldScore]:
    """Score every model on every fold: AUC for classifiers, r2 for regressors.

    ``by`` is the row's id, whose hash deals the folds; without it the features and the label do.

    Folds are a column, stratified by label for classifiers.  The scaler is fitted on all rows
    unless ``scale_inside_fold``, which keeps the validation rows out of it. Closed-form learners share one
    read of sums per fold: a fold's model is that of the other folds' sums. Folds are settled apart, so that a fold is read
    without the others; ``train`` is not settled before if it is already (``stored``).
    """
    for name in models:
        learner(name, kind)
    own = [by] if by else []
    rows = train.select(*own, *features, label)
    dealt = with_folds(rows, folds, label=label if kind == CLASSIFIER else None, by=own or None, to="_fold", stored=stored)
    folded = settle(dealt.select(*features, label, "_fold"), partition_by=["_fold"])
    shared, sums, scalers = None, None, None
    measure = "auc" if kind == CLASSIFIER else "r2"
    scores = []
    for name, params in models.items():
        entry = learner(name, kind)
        if isinstance(entry, ClosedForm):
            entry.check(name, params)
            sums = sums or entry.sums(folded, features, label, ["_fold"])
            scalers = scalers or _fold_scalers(train, folded, features, folds, scale, scale_inside_fold)
            scores += _closed_scores(folded, name, params, sums, scalers, features, label)
            continue
        if shared is None and not scale_inside_fold:
            shared = feature_stages(train, features, scale=scale)
        for i in range(folds):
            learn, check = folded.where(F.col("_fold") != i), folded.where(F.col("_fold") == i)
            fitted = fit(
                learn,
                name=name,
                params=params,
                kind=kind,
                features=features,
                label=label,
                scale=scale,
                stages=shared,
            )
            scores.append(FoldScore(name, i, evaluate(fitted, check)[measure]))
    return scores


def _fold_scalers(train, folded, features, folds, scale, inside) -> list[Scaler | None]:
    """The scaler of each fold's model."""
    if not scale:
        return [None] * folds
    if not inside:
        return [fit_scaler(train, features)] * folds
    return [fit_scaler(folded.where(F.col("_fold") != i), features) for i in range(folds)]


def _closed_scores(folded: DataFrame, name: str, params: dict, sums: dict, scalers: list, features: Sequence[str], label: str) -> list[FoldScore]:
    """Each fold's rows are scored by the model of the others; every row is read once."""
    answered = []
    for i, scaler in enumerate(scalers):
        others = {key: m for key, m in sums.items() if key[0] != i}
        if not others:
            raise ValueError(f"fold {i} holds all rows")
        formula = CLOSED_FORMS[name].solved(_scaled(others, scaler, features), params)
        values = [scaled(c, scaler) if scaler else F.col(c) for c in features]
        # A fold at a time: all models in one expression would not be compiled.
        answered.append(folded.where(F.col("_fold") == i).select("_fold", F.col(label).alias("y"), formula.score(values).alias("score")))
    scored = settle(reduce(DataFrame.unionByName, answered))
    if CLOSED_FORMS[name].classifies:
        return [FoldScore(name, i, metrics.roc_auc(scored.where(F.col("_fold") == i)).first()["auc"]) for i in range(len(scalers))]
    parts = metrics.regression_metrics(scored, predicted="score", by=["_fold"]).collect()
    found = {r["_fold"]: r["r2"] for r in parts}
    return [FoldScore(name, i, found.get(i)) for i in range(len(scalers))]


def mean_scores(spark, scores: Sequence[FoldScore]) -> DataFrame:
    """Mean and population deviation of the fold scores per model, in listed order."""
    rows = [(i, s.name, s.fold, s.score) for i, s in enumerate(scores)]
    table = spark.createDataFrame(rows, "place int, name string, fold int, score double")
    return table.groupBy("name").agg(
        F.min("place").alias("place"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
    )


def best_model(summary: DataFrame) -> str:
    """Highest mean score; of equals the one listed first."""
    top = summary.orderBy(F.col("mean_score").desc_nulls_last(), F.col("place").asc()).first()
    return top["name"]


def select_model(train: DataFrame, models: dict[str, dict], **how) -> str:
    """The only model listed, or the best of a cross-validation."""
    if not models:
        raise ValueError("no model is listed")
    if len(models) == 1:
        name = next(iter(models))
        learner(name, how["kind"])
        return name
    return best_model(mean_scores(train.sparkSession, cross_validate(train, models, **how)))
