"""Language identification as mixture inference.

A document is a mixture of languages; each word is drawn from one of them, with the likelihood of its letter trigrams.
Expectation-maximisation gives the proportions, and the set of languages is the one with the lowest
penalised likelihood (BIC) on the way from all languages down to one.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from moorage.llm.base import map_rows

UNKNOWN = "und"
_BITS = 16
_LETTER: np.ndarray | None = None
_CHARACTERS_AT_ONCE = 1_000_000


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the letter trigrams of all words (with one boundary on each side), and where each word begins."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint32)
    middle = np.flatnonzero(letter)
    if not len(middle):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    slots = (codes[middle - 1] * np.uint32(0x9E3779B1) ^ codes[middle] * np.uint32(0x85EBCA6B) ^ codes[middle + 1] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - _BITS)
    return slots, np.flatnonzero(~letter[middle - 1])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # slots x languages

    def predict(self, texts: list[str | None], *, rounds: int = 6) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its proportion, and all proportions (texts x languages) of every text."""
        count = len(self.languages)
        shares = np.zeros((len(texts), count))
        if count:
            begin = 0
            while begin < len(texts):  # a bounded number of characters at once, or one text
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end] or "") <= _CHARACTERS_AT_ONCE):
                    held += len(texts[end] or "")
                    end += 1
                shares[begin:end] = self._mixtures(texts[begin:end], rounds)
                begin = end
        best = shares.argmax(1) if count else np.zeros(len(texts), int)
        top = shares[np.arange(len(texts)), best] if count else np.zeros(len(texts))
        return [self.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, top)], top, shares

    def _mixtures(self, texts: list[str | None], rounds: int) -> np.ndarray:
        docs, count = len(texts), len(self.languages)
        per_word, owner = [], []
        for d, text in enumerate(texts):
            slots, begins = trigrams(text or "")
            if len(begins):
                per_word.append(np.add.reduceat(self.log_p[slots], begins, axis=0))
                owner.append(np.full(len(begins), d))
        out = np.zeros((docs, count))
        if not per_word:
            return out
        likelihood, owner = np.concatenate(per_word).astype(np.float64), np.concatenate(owner)
        top = likelihood.max(1, keepdims=True)
        scaled = np.exp(likelihood - top)
        words = np.bincount(owner, minlength=docs)
        at = np.searchsorted(owner, np.arange(docs))
        some = words > 0
        rest = np.where(some, np.bincount(owner, weights=top[:, 0], minlength=docs), 0.0)

        alive = np.repeat(some[:, None], count, axis=1)
        best_cost = np.full(docs, np.inf)
        for size in range(count, 0, -1):
            share = alive / np.maximum(1, alive.sum(1, keepdims=True))
            for _ in range(rounds if size > 1 else 1):
                joint = scaled * share[owner]
                total = np.maximum(joint.sum(1, keepdims=True), 1e-300)
                sums = np.add.reduceat(joint / total, at[some], axis=0)
                share[some] = sums / words[some, None]
            fit = np.zeros(docs)
            fit[some] = np.add.reduceat(np.log(np.maximum((scaled * share[owner]).sum(1), 1e-300)), at[some])
            cost = -2 * (fit + rest) + (size - 1) * np.log(np.maximum(words, 2))
            better = some & (cost < best_cost)
            out[better], best_cost[better] = share[better], cost[better]
            weakest = np.where(alive, share, np.inf).argmin(1)
            alive[np.arange(docs), weakest] = False
        return out


def train(docs: DataFrame, *, smoothing: float = 0.1, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram counts of all rows with a language, whole texts; rows without one are left out.

    Each task adds up its counts and sends a number per language and slot, so the shuffle and what reaches the driver
    do not grow with the texts.
    """
    size = 1 << _BITS

    def rows(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for content, language in zip(batch["text"], batch["lang"]):
                own = counts.setdefault(language, np.zeros(size, np.int64))
                slots, _ = trigrams(content or "")
                own += np.bincount(slots, minlength=size)
        for language, own in counts.items():
            slots = np.flatnonzero(own)
            yield {"lang": [language] * len(slots), "slot": slots.tolist(), "n": own[slots].tolist()}

    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    sums = map_rows(known, rows, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["lang"].unique()))
    counts = np.full((size, len(languages)), smoothing)
    for k, language in enumerate(languages):
        own = sums[sums["lang"] == language]
        counts[own["slot"].to_numpy(), k] += own["n"].to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion) and ``mixture`` (language -> proportion), in
    place of columns of those names.

    From the whole text alone; a null text or one without a letter has ``und`` and 0. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def mixed(texts: pd.Series) -> pd.DataFrame:
        best, top, shares = sent.value.predict(list(texts))
        maps = [{name: float(s) for name, s in zip(sent.value.languages, row) if s > 1e-9} for row in shares]
        return pd.DataFrame({"lang_pred": best, "score": top, "mixture": maps})

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "mixture")]
    out = docs.select(*kept, mixed(F.col(text)).alias("found of this operator"))
    return out.select(*kept, *(F.col(f"`found of this operator`.{c}") for c in ("lang_pred", "score", "mixture")))
