"""The ranking job: requests and history in, ordered candidates out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.operators.cleaning import clean, derive
from moorage.operators.enrich import enrich
from moorage.operators.latest import latest_state
from moorage.operators.ranking import RankSpec, fold_messages, pass_lone, with_rank
from moorage.operators.registry import Registry
from moorage.operators.requests import MESSAGE, describe, merge_repeats, route, unfold
from moorage.operators.rolling import FRAME
from moorage.operators.scoring import history_scores, model_scores
from moorage.settle import settle

log = logging.getLogger(__name__)

#: Enriched candidates -> the same with ``classification`` and ``regression``.
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ModelChoice:
    name: str
    version: str | int = "latest"


@dataclass(frozen=True)
class RankJob:
    """How requests are scored and ordered."""

    spec: RankSpec = field(default_factory=RankSpec)
    complex_templates: Sequence[str] = ()
    frame: timedelta = FRAME
    version: str = "1.1.0"


def history_state(
    history: DataFrame, *, complex_templates: Sequence[str] = (), frame: timedelta = FRAME
) -> DataFrame:
    """Newest state per (provider, template), settled so that it joins by its real size."""
    rows = derive(clean(history), complex_templates=complex_templates)
    return settle(latest_state(rows, frame=frame))


def registered_scorer(
    registry: Registry, *, classifier: ModelChoice, regressor: ModelChoice, message: str = MESSAGE
) -> Scorer:
    """Scorer with two registered models, loaded once.  A model that is not there scores -1."""

    def load(choice: ModelChoice) -> tuple[PipelineModel | None, list[str]]:
        try:
            return registry.load(choice.name, choice.version)
        except ValueError as error:
            log.error("%s", error)
            return None, []

    class_model, class_features = load(classifier)
    time_model, time_features = load(regressor)

    def score(enriched: DataFrame) -> DataFrame:
        return model_scores(
            enriched,
            classifier=class_model,
            regressor=time_model,
            class_features=class_features,
            duration_features=time_features,
            message=message,
        )

    return score


def candidates(messages: DataFrame, *, complex_templates: Sequence[str] = (), echo: Sequence[str] | None = None) -> DataFrame:
    """Described candidates of all messages, repeats merged."""
    return merge_repeats(describe(unfold(messages, echo=echo), complex_templates=complex_templates))


def rank_messages(
    messages: DataFrame,
    state: DataFrame,
    *,
    job: RankJob = RankJob(),
    scorer: Scorer = history_scores,
    echo: Sequence[str] | None = None,
) -> DataFrame:
    """(msg_id, uuid, ranked_providers) for every message with a candidate.

    Several candidates are scored and ordered; a single one passes with -1 scores; a message
    without candidates gets no answer.  Single ones take the same way, so that every message is
    read and parsed once, and their scores are replaced at the end.

    ``echo`` names the fields of a candidate that its answer carries beside the scores, all by default: each goes
    through the shuffle and the sorts by message, typed fields a second time beside their columns.
    """
    asked = route(messages).where(F.col("route") != "none")
    described = candidates(asked, complex_templates=job.complex_templates, echo=echo)
    ranked = pass_lone(with_rank(scorer(enrich(described, state)), job.spec))
    return fold_messages(ranked)
