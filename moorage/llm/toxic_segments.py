"""Toxic passages by maximum-scoring segment search, and a document score by extreme-value calibration.

Tokens score their log-odds between toxic and clean documents. The odds of a word have a Dirichlet prior with
the mean of its six-letter beginning, that of its five letters, and so on to the base share, so words not
met before take the odds of their stems. Less a drift, clean text scores below zero on average; then the maximal
scoring segments are the toxic passages, and by Karlin and Altschul the number of chance segments
of score S or more in n clean tokens is K n exp(-lambda S).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, map_texts, prepare_workers, settle

TOKEN = re.compile(r"\w+")
#: Letters of the stems that lend a word their odds, shortest first.
STEMS = (3, 4, 5, 6)
PASSAGES = "doc_id bigint, start int, stop int, passage string, score double, e_value double"
_KEPT_WORDS = 200_000
_PER_UNIT = 20  # steps of the score histogram


def _levels(word: str) -> list[str]:
    """The word's stems and itself, each a key of its own kind."""
    return [f"{n}{word[:n]}" for n in STEMS if len(word) > n] + ["=" + word]


@dataclass(frozen=True)
class ToxicModel:
    counts: dict[str, tuple[int, int]]  # key -> toxic and clean documents that hold it
    base: float  # share of toxic documents over all (document, token) pairs
    strength: float = 20.0
    drift: float = 1.0
    decay: float = 1.0  # lambda
    density: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 1.0
    _known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def token_score(self, word: str) -> float:
        known = self._known.get(word)
        if known is None:
            share = self.base
            for key in _levels(word):
                found = self.counts.get(key)
                if found is not None:
                    toxic, clean = found
                    share = (toxic + self.strength * share) / (toxic + clean + self.strength)
            known = float(np.log(share / (1 - share)) - np.log(self.base / (1 - self.base)) - self.drift)
            if len(self._known) >= _KEPT_WORDS:
                self._known.clear()
            self._known[word] = known
        return known

    def segments(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and (score, first, last token) of every maximal scoring segment.

        Odds come from documents that hold a token, so its k-th occurrence in a passage adds a k-th of them: one
        word repeated over and over is no passage. Each passage counts anew, whatever stands elsewhere in the text.
        """
        words = TOKEN.findall(text.lower())
        scores = list(map(self.token_score, words))
        found = []
        for segment in maximal_segments(scores):
            first, last = segment[1:]
            good = [words[k] for k in range(first, last + 1) if scores[k] > 0]
            found += [segment] if len(good) == len(set(good)) else self._damped(words, scores, first, last)
        return len(scores), found

    def _damped(self, words: list[str], scores: list[float], first: int, last: int) -> Iterable[tuple[float, int, int]]:
        """Passages of a segment with repeated words, from left to right.

        A passage ends at its highest total, found when the total is used up; the next one begins after it.
        """
        while first <= last:
            if scores[first] <= 0:
                first += 1
                continue
            times: Counter = Counter()
            total, best, end = 0.0, 0.0, first
            for place in range(first, last + 1):
                score = scores[place]
                if score > 0:
                    times[words[place]] += 1
                    score = (score + self.drift) / times[words[place]] - self.drift
                total += score
                if total > best:
                    best, end = total, place
                elif total <= 0:
                    break
            yield best, first, end
            first = end + 1

    def evidence(self, text: str | None) -> float:
        """ln(1 + x) of the text's extreme value x = lambda S - ln(K n), S its best segment's score; 0 for x < 0.

        exp(-x) is the number of segments so good that clean text of this length has by chance. The best passage
        decides: many weak segments are what long clean texts have.
        """
        return self.weigh(*self.best(text))

    def best(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and the best segment's score, 0 for none."""
        n, found = self.segments(text or "")
        return n, max((s for s, _, _ in found), default=0.0)

    def weigh(self, n: int, best: float) -> float:
        return float(np.log1p(max(0.0, self.decay * best - np.log(max(1.0, self.density * n)))))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(text), -500, 500))))


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments in one pass (Ruzzo and Tompa), from left to right.

    Candidates are kept with the running totals before and after them. A new one is joined with the
    nearest earlier candidate that begins lower, if that one does not end higher.
    """
    found: list[tuple[float, float, int, int]] = []  # total before, total after, first, last
    total = 0.0
    for place, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        left, right, first = before, total, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, place))
    return [(right - left, first, last) for left, right, first, last in found]


def count_keys(labelled: DataFrame) -> DataFrame:
    """key, toxic, clean: labelled documents (columns text, toxic) that hold each word or stem."""

    def rows(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            rows = {"key": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]}
            for c in seen:
                c.clear()
            return rows

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                keys = {key for word in set(TOKEN.findall((text or "").lower())) for key in _levels(word)}
                seen[toxic].update(keys)
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield out()
        yield out()

    counted = map_rows(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), rows, "key string, toxic bigint, clean bigint")
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _root(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum of weights * exp(lambda * score) = 1; 1 where clean text never scores above zero."""
    if scores.max(initial=-1.0) <= 0 or scores @ weights >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while weights @ np.exp(np.minimum(high * scores, 700)) < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if weights @ np.exp(np.minimum(mid * scores, 700)) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with halved steps; a small ridge gives separable labels a fit."""
    design = np.stack([np.ones_like(x), x], axis=1)
    theta, ridge = np.zeros(2), np.array([1e-3, 1e-2])

    def loss(t: np.ndarray) -> float:
        f = design @ t
        return float((np.logaddexp(0, f) - y * f).sum() + ridge @ t**2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        down = design.T @ (y - p) - ridge * theta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), down)
        size = 1.0
        while size > 1e-6 and loss(theta + size * step) > loss(theta):
            size /= 2
        theta = theta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 60_000, doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Fit on a bounded sample of labelled rows (``labels``: doc_id, toxic); null labels are left out.

    The sample is the ``most_labelled`` rows with the lowest hash of their id; an id with both labels counts
    as toxic. Of its words and stems those count whose toxic share is away from the base share by more than chance
    among as many keys allows, so the model is bounded by the sample. Without any toxic or any clean row the model scores every text with the base share.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    labelled = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    counted = count_keys(labelled).cache()
    try:
        totals = counted.agg(F.count("key").alias("keys"), *(F.sum(F.when(F.col("key").startswith("="), F.col(c))).alias(c) for c in ("toxic", "clean"))).first()
        if not totals.toxic or not totals.clean:
            share = 0.999 if totals.toxic else 0.001
            return ToxicModel({}, 0.5, intercept=float(np.log(share / (1 - share))), slope=0.0)
        base = totals.toxic / (totals.toxic + totals.clean)
        n = F.col("toxic") + F.col("clean")
        z = F.abs(F.col("toxic") - n * base) / F.sqrt(n * base * (1 - base))
        strong = counted.where(z >= float(np.sqrt(2 * np.log(max(3, totals["keys"]))))).collect()
    finally:
        counted.unpersist()
    return calibrate(labelled, ToxicModel({r.key: (r.toxic, r.clean) for r in strong}, base))


def calibrate(labelled: DataFrame, model: ToxicModel) -> ToxicModel:
    """lambda and K from the sample's clean rows, then the map from evidence to probability from all of it."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            out = {"toxic": batch["toxic"], "n": [], "best": [], "scores": [], "times": []}
            for text in batch["text"]:
                words = TOKEN.findall((text or "").lower())
                seen = Counter(round(_PER_UNIT * s) for s in map(sent.value.token_score, words))
                out["n"].append(len(words))
                out["best"].append(sent.value.best(text)[1])
                out["scores"].append(list(seen.keys()))
                out["times"].append(list(seen.values()))
            yield out

    schema = "toxic int, n int, best double, scores array<int>, times array<int>"
    found = settle(map_rows(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), rows, schema))
    pairs = found.where("toxic = 0").select(F.explode(F.arrays_zip("scores", "times")).alias("p"))
    tokens = pairs.groupBy("p.scores").agg(F.sum("p.times").alias("times")).orderBy("scores").collect()
    weights = np.array([r.times for r in tokens], float)
    decay = _root(np.array([r.scores for r in tokens], float) / _PER_UNIT, weights / max(1.0, weights.sum()))

    got = found.select("toxic", "n", "best").collect()  # three numbers a row of the bounded sample
    clean = [r for r in got if not r.toxic]
    chance = float(sum(r.n * np.exp(-decay * r.best) for r in clean))
    density = len(clean) / chance if chance > 0 else 1.0
    fitted = replace(model, decay=decay, density=density)
    pairs = sorted((r.toxic, fitted.weigh(r.n, r.best)) for r in got)  # the same sums on every run
    intercept, slope = _logistic(np.array([e for _, e in pairs]), np.array([t for t, _ in pairs], float))
    return replace(fitted, intercept=intercept, slope=slope)


def passages(docs: DataFrame, model: ToxicModel, *, most_expected: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage (E-value at most ``most_expected``): its characters, score and E-value.

    A null or empty text has none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        names = [c.split()[0] for c in PASSAGES.split(", ")]
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for key, content in zip(batch["doc_id"], batch["text"]):
                for row in _passages(content or "", sent.value, most_expected):
                    for name, value in zip(names, (key, *row)):
                        out[name].append(value)
            yield out

    return map_rows(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), rows, PASSAGES)


def _passages(text: str, model: ToxicModel, most: float) -> Iterable[tuple[int, int, str, float, float]]:
    n, found = model.segments(text)
    low = text.lower()
    if not found or len(low) != len(text):  # characters whose lower case is longer would shift the spans
        text = low
    spans = [m.span() for m in TOKEN.finditer(low)] if found else []
    for score, first, last in found:
        expected = float(max(1.0, model.density * n) * np.exp(-model.decay * score))
        if expected <= most:
            start, stop = spans[first][0], spans[last][1]
            yield start, stop, text[start:stop], score, expected


def scorer(spark: SparkSession, model: ToxicModel) -> Callable[[Column], Column]:
    """The score of a column of whole texts; null text is empty. Equal texts score alike, and each row gets its score."""
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(model)
    return map_texts(lambda texts: [sent.value.score(t) for t in texts], "double")


def score(docs: DataFrame, model: ToxicModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (in place of a column of that name), from the whole text alone. No shuffle."""
    return docs.withColumn("score", scorer(docs.sparkSession, model)(F.col(text)))
