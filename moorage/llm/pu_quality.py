"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are told apart by a linear model over how a text is written (character-class
n-grams and repetition), fitted by the non-negative unbiased risk: with class prior p and logistic loss l,

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

where the bracket may not fall below zero, as an expected loss on negatives can't. The prior is estimated too:
among the texts that a positive-against-unlabelled model ranks highest there are hardly any negatives,
so there the unlabelled share divided by the positive share is the prior.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.llm.adaptive_rules import WORD, repeated_words
from moorage.llm.base import map_rows, map_texts, prepare_workers

_CLASS_OF = np.full(256, 11, np.uint8)  # 11: bytes of characters beyond ASCII
for _n, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\v\f", ".,", ";:?'\"()-", "!", "|", "#*$%&<>")):
    _CLASS_OF[[ord(c) for c in _chars]] = _n
_CLASS_OF[[c for c in range(128) if _CLASS_OF[c] == 11]] = 12
_CLASSES = 13
_TRIGRAM_SLOTS = 256
_SLOT_OF = np.array([zlib.crc32(bytes((i // 169, i // 13 % 13, i % 13))) % _TRIGRAM_SLOTS for i in range(_CLASSES**3)])
_SHAPE = 8
N_FEATURES = _CLASSES**2 + _TRIGRAM_SLOTS + _SHAPE


def features(text: str | None) -> np.ndarray:
    """The features of a whole text: square roots of n-gram shares, and repetition. An empty text has zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    kinds = _CLASS_OF[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
    n = len(kinds)
    if n > 1:
        pairs = kinds[:-1] * _CLASSES + kinds[1:]
        out[: _CLASSES**2] = np.sqrt(np.bincount(pairs, minlength=_CLASSES**2) / n)
        if n > 2:
            triples = np.bincount(pairs[:-1] * _CLASSES + kinds[2:], minlength=_CLASSES**3)
            out[_CLASSES**2 : -_SHAPE] = np.sqrt(np.bincount(_SLOT_OF, weights=triples, minlength=_TRIGRAM_SLOTS) / n)
    words = WORD.findall(text)
    if words:
        distinct = set(words)
        lines = text.split("\n")
        k = len(words)
        out[-_SHAPE:] = (
            1.0,
            min(1.0, n / k / 20),
            np.log1p(k) / 10,
            len(distinct) / k,
            len(distinct) / np.sqrt(k) / 20,
            1 - len(set(lines)) / len(lines),
            repeated_words(words) / k,
            min(1.0, max(map(len, words)) / 100),
        )
    return out


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid((rows - self.mean) / self.scale @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The unbiased risk's two parts, of scores before the sigmoid: on positives, and on negatives, which may not count below zero."""
    return prior * float(np.logaddexp(0, -positive).mean()), float(np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean())


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of what is stepped down, by each score: the risk, or, where that on negatives has fallen below zero, its rise.

    ``prior`` None: of the plain logistic loss of positives against unlabelled.
    """
    up, uu = _sigmoid(positive), _sigmoid(unlabelled)  # d l(-f) / df; that of l(f) is up - 1
    if prior is None:
        return (up - 1) / len(up), uu / len(uu)
    if risk(positive, unlabelled, prior)[1] >= 0:
        return prior * ((up - 1) - up) / len(up), uu / len(uu)
    return prior * up / len(up), -uu / len(uu)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Adam along :func:`slopes`."""
    w, b = np.zeros(positive.shape[1], np.float32), np.float32(0)
    first, second = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, steps + 1):
        gp, gu = slopes(positive @ w + b, unlabelled @ w + b, prior)
        gradient = np.append(positive.T @ gp + unlabelled.T @ gu + decay * w, gp.sum() + gu.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return w, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both samples' scores.

    For a threshold above which unlabelled texts are all positive, the shares above it have the ratio of
    the prior. The lowest ratio counts, with a bound on each share's sampling error, over thresholds that a
    tenth of the positives pass at least.
    """
    best = 1.0
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    for cut in np.quantile(positive, np.linspace(0, 0.9, 91)):
        share = (positive >= cut).mean()
        best = min(best, ((unlabelled >= cut).mean() + slack * 0.5) / share)
    return float(np.clip(best, 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 400, decay: float = 1e-4) -> PuModel:
    """The model for feature rows of trusted positives and of unlabelled texts.

    Without positives every score is 0.5; without unlabelled rows the positives stand for them.
    """
    if not len(positive):
        return PuModel(np.zeros(N_FEATURES), 0.0, np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    unlabelled = unlabelled if len(unlabelled) else positive
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0, dtype=np.float64).astype(np.float32), every.std(0, dtype=np.float64).astype(np.float32)
    scale = np.where(scale > 1e-6, np.maximum(scale, np.float32(0.01)), np.float32(1))
    every -= mean
    every /= scale
    p, u = every[: len(positive)], every[len(positive) :]
    halves = [slice(0, None, 2), slice(1, None, 2)]
    seen_p, seen_u = [], []
    for own, other in (halves, halves[::-1]):  # scores of texts that the ranking model was not fitted on
        w, b = _descend(p[own], u[own], None, steps // 2, decay)
        seen_p.append(p[other] @ w + b)
        seen_u.append(u[other] @ w + b)
    prior = estimate_prior(np.concatenate(seen_p), np.concatenate(seen_u)) if len(p) > 1 and len(u) > 1 else 0.5
    w, b = _descend(p, u, prior, steps, decay)
    return PuModel(w, float(b), mean, scale, prior)


def train(docs: DataFrame, positives: DataFrame, *, most_positive: int = 6_000, most_unlabelled: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> PuModel:
    """Fit on bounded samples: the trusted ids in ``positives`` (one column, doc_id) and other documents.

    Samples are the rows with the lowest hash of their id, so they are the same on every run and at any
    partitioning; the bounds are the parameters. Only their features reach the driver. A document whose
    id is not among the positives counts as unlabelled, whatever is known of it.
    """
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    order = F.xxhash64("doc_id")
    trusted = positives.select(F.col("doc_id").cast("bigint")).distinct()
    chosen = ids.join(trusted, "doc_id", "left_semi").orderBy(order, "doc_id").limit(most_positive).withColumn("positive", F.lit(True))
    others = ids.join(trusted, "doc_id", "left_anti").orderBy(order, "doc_id").limit(most_unlabelled).withColumn("positive", F.lit(False))
    sample = chosen.unionByName(others).distinct()
    wanted = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")

    def rows(batches):
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "positive": batch["positive"], "x": [features(t).tobytes() for t in batch["text"]]}

    got = map_rows(wanted.select("doc_id", "positive", "text"), rows, "doc_id bigint, positive boolean, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))  # the same sums on every run

    def matrix(positive: bool) -> np.ndarray:
        own = [r.x for r in got if r.positive == positive]
        return np.frombuffer(b"".join(own), np.float32).reshape(-1, N_FEATURES)

    return fit(matrix(True), matrix(False))


def scorer(spark: SparkSession, model: PuModel) -> Callable[[Column], Column]:
    """The score of a column of whole texts; null text is empty."""
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(model)

    def scored(texts: list[str | None]) -> list[float]:
        rows = np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)
        return sent.value.score(rows).tolist()

    return map_texts(scored, "double")


def score(docs: DataFrame, model: PuModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (in place of a column of that name), from the whole text alone. No shuffle."""
    return docs.withColumn("score", scorer(docs.sparkSession, model)(F.col(text)))
