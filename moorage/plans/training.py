"""The training job: history in, registered models out."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.operators import models
from moorage.operators.cleaning import clean, derive
from moorage.operators.importance import importance
from moorage.operators.outliers import iqr_filter
from moorage.operators.registry import ModelInfo, Registry
from moorage.operators.rolling import FRAME, rolling_history
from moorage.operators.sampling import SEED, exact_split
from moorage.schema import CLASS_TARGET, DEFAULT_FEATURES, DURATION_TARGET
from moorage.settle import settle

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class TrainSpec:
    """What to train and how."""

    classifiers: dict[str, dict] = field(default_factory=lambda: {"RandomForestClassifier": {}})
    regressors: dict[str, dict] = field(default_factory=lambda: {"RandomForestRegressor": {}})
    features: Sequence[str] = tuple(DEFAULT_FEATURES)
    class_target: str = CLASS_TARGET
    duration_target: str = DURATION_TARGET
    complex_templates: Sequence[str] = ()
    test_size: float = 0.2
    folds: int = 5
    remove_outliers: bool = False
    q1: float = 0.25
    q3: float = 0.75
    fence: float = 1.5
    scale: bool = False
    scale_inside_fold: bool = False
    frame: timedelta = FRAME
    seed: int = SEED
    explained_rows: int | None = None

    def __post_init__(self):
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie between 0 and 1")
        for kind, names in ((models.CLASSIFIER, self.classifiers), (models.REGRESSOR, self.regressors)):
            for name in names:
                models.learner(name, kind)

    def check(self, columns: Sequence[str]) -> None:
        wanted = {*self.features, self.class_target, self.duration_target}
        absent = sorted(wanted - set(columns))
        if absent:
            raise ValueError(f"the training data lacks the columns {absent}")


def feature_table(
    history: DataFrame, *, complex_templates: Sequence[str] = (), frame: timedelta = FRAME
) -> DataFrame:
    """Clean history with all derived and rolling columns."""
    return rolling_history(derive(clean(history), complex_templates=complex_templates), frame=frame)


def time_span(rows: DataFrame, *, time: str = "timestamp") -> DataFrame:
    return rows.agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def train(spark: SparkSession, history: DataFrame, spec: TrainSpec, registry: Registry) -> dict[str, int]:
    """Fit and register a success classifier and a duration regressor.

    Returns model name -> version; nothing when no row survives cleaning.
    """
    table = feature_table(history, complex_templates=spec.complex_templates, frame=spec.frame)
    spec.check(table.columns)
    kept = ["uuid", "timestamp", *spec.features, spec.class_target, spec.duration_target]
    # Written once; every later pass reads only the columns it needs.
    table = settle(table.select(*dict.fromkeys(kept)))
    if table.isEmpty():
        log.warning("no usable history: no model is trained")
        return {}
    span = time_span(table).first()
    train_rows, test_rows = exact_split(table, spec.test_size, by=["uuid"], seed=spec.seed, stored=True)
    jobs = [
        (models.CLASSIFIER, spec.classifiers, spec.class_target),
        (models.REGRESSOR, spec.regressors, spec.duration_target),
    ]
    versions = {}
    for kind, names, target in jobs:
        columns = [*spec.features, target]
        learn, check = train_rows.select(*columns), test_rows.select(*columns)
        if spec.remove_outliers:
            # From the training rows only: the test rows stay as they are.
            learn = settle(iqr_filter(learn, columns, q1=spec.q1, q3=spec.q3, k=spec.fence))
        how = {"kind": kind, "features": list(spec.features), "label": target, "scale": spec.scale}
        name = models.select_model(
            learn, names, folds=spec.folds, scale_inside_fold=spec.scale_inside_fold, **how
        )
        fitted = models.fit(learn, name=name, params=names[name], **how)
        versions[name] = registry.append(
            fitted,
            info=ModelInfo(
                start_time=span["start_time"],
                end_time=span["end_time"],
                features=columns,
                remove_outliers=spec.remove_outliers,
                scaling=spec.scale,
            ),
            metrics=models.train_and_test_metrics(fitted, learn, check),
            importances=importance(fitted, learn, explained_rows=spec.explained_rows),
        )
    return versions
