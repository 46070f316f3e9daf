"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every training text is a query; items at or above a threshold are retrieved, all of them, and a
retrieved item counts where the text around the passage holds enough of its question and of its answer.

Scores are BM25 over the passage's distinct words, divided by the item's score for its own words, so one
threshold fits short and long items. A term's postings are blocks of items with their highest weight; the search
passes over blocks whose highest weights together stay below the threshold.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, map_texts, settle

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest of ASCII separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_BLOCK = 32
MATCHES = "doc_id bigint, item_id bigint, score double, first_word bigint, question_overlap double, answer_overlap double"
_NAMES = [c.split()[0] for c in MATCHES.split(", ")]


@dataclass(frozen=True)
class SearchSpec:
    least_score: float = 0.4
    least_question: float = 0.5
    least_answer: float = 0.5
    #: Words of a run that must agree for overlap.
    run: int = 4
    #: Items in one index, which is broadcast; more items make more indexes, each searched by all passages.
    index_items: int = 20_000
    k1: float = 1.2
    b: float = 0.75


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's question and answer: the answer is its last sentence, or the last third of a single sentence."""
    sentences = [w for w in map(words_of, text.replace("\n", ". ").replace("? ", ". ").replace("! ", ". ").split(". ")) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


class ItemIndex:
    """Postings of some items; document frequencies may come from more items than these."""

    def __init__(self, items: list[tuple[int, str]], spec: SearchSpec, frequencies: Counter, n_items: int, mean_length: float) -> None:
        self.spec = spec
        self.items: list[tuple[int, list[bytes], list[bytes]]] = []
        weights: dict[bytes, list[tuple[int, float]]] = {}
        longest = 1
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            own = {t: self._weight(tf, len(words), frequencies[t], n_items, mean_length) for t, tf in Counter(words).items()}
            whole = sum(own.values())
            for term, weight in own.items():
                weights.setdefault(term, []).append((len(self.items), weight / whole))
            self.items.append((key, *question_and_answer(text)))
            longest = max(longest, len(words))
        #: Half a passage: passages are as long as the longest item's words at least, and overlap by half.
        self.half = max(32, -(-longest // 2))
        self.terms = {t: n for n, t in enumerate(weights)}
        self.postings = [[i for i, _ in p] for p in weights.values()]
        self.weights = [[w for _, w in p] for p in weights.values()]
        self.block_tops = [[max(w[k : k + _BLOCK]) for k in range(0, len(w), _BLOCK)] for w in self.weights]
        self.tops = np.array([max(w) for w in self.weights])
        self._mark_essential()

    def _mark_essential(self) -> None:
        """Split each item's terms: the commonest ones, up to half the threshold together, can't decide alone.

        A passage reaches the threshold for an item only if the item's other terms in it bring the rest.
        """
        common = np.zeros(len(self.items))
        kept: list[tuple[int, int, float]] = []
        for t in sorted(range(len(self.postings)), key=lambda t: (-len(self.postings[t]), t)):
            for item, weight in zip(self.postings[t], self.weights[t]):
                if common[item] + weight <= self.spec.least_score / 2:
                    common[item] += weight
                else:
                    kept.append((t, item, weight))
        kept.sort()
        table = np.array(kept, np.float64).reshape(-1, 3)
        self._essential = np.searchsorted(table[:, 0], np.arange(len(self.postings) + 1))
        self._essential_items, self._essential_weights = table[:, 1].astype(np.int64), table[:, 2]
        self._rest = self.spec.least_score - common

    def _weight(self, tf: int, length: int, df: int, n_items: int, mean_length: float) -> float:
        idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
        return idf * tf * (self.spec.k1 + 1) / (tf + self.spec.k1 * (1 - self.spec.b + self.spec.b * length / mean_length))

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """First word and known terms of every passage that may reach the threshold for some item."""
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return
        keys = np.unique(places // self.half * len(self.terms) + ids[places])
        half, term = keys // len(self.terms), keys % len(self.terms)
        begins, counts = self._essential[term], self._essential[term + 1] - self._essential[term]
        ends = np.cumsum(counts)
        if not ends[-1]:
            return
        at = np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1])
        # Essential weight of each (half, item); a passage is a half and the next one.
        pairs = np.repeat(half, counts) * len(self.items) + self._essential_items[at]
        both, inverse = np.unique(np.concatenate([pairs, pairs - len(self.items)]), return_inverse=True)
        brought = np.bincount(inverse, weights=np.tile(self._essential_weights[at], 2))
        good = both[brought >= self._rest[both % len(self.items)] - 1e-9] // len(self.items)
        edges = np.searchsorted(half, np.arange(half[-1] + 3))
        for h in np.unique(np.maximum(good, 0)).tolist():
            yield h * self.half, np.unique(term[edges[h] : edges[h + 2]]).tolist()

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose weights over ``terms`` add up to ``least``: document at a time, block-max WAND."""
        least -= 1e-9
        lists = [[self.postings[t][0], 0, t] for t in terms]  # current item, place in the postings, term
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += float(self.tops[t])
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # Blocks that may hold the pivot item, and the last item up to which their maxima hold.
            tight, upto = 0.0, None
            for entry in lists[: pivot + 1]:
                own = self.postings[entry[2]]
                block = bisect_left(own, item, entry[1]) // _BLOCK
                if block < len(self.block_tops[entry[2]]):
                    tight += self.block_tops[entry[2]][block]
                    end = own[min(len(own), (block + 1) * _BLOCK) - 1]
                    upto = end if upto is None else min(upto, end)
            if tight < least:
                after = item + 1 if upto is None else upto + 1
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][0])
                self._forward(lists, pivot, max(after, item + 1))
            elif lists[0][0] == item:
                score = sum(self.weights[t][p] for i, p, t in lists[: pivot + 1] if i == item)
                if score >= least:
                    found.append((item, score))
                self._forward(lists, pivot, item + 1)
            else:
                self._forward(lists, pivot, item)
        return found

    def _forward(self, lists: list[list[int]], upto: int, item: int) -> None:
        """Move the first lists to their first posting at ``item`` or later; drop those that end."""
        for entry in lists[: upto + 1]:
            own = self.postings[entry[2]]
            if entry[0] < item:
                entry[1] = bisect_left(own, item, entry[1])
                entry[0] = own[entry[1]] if entry[1] < len(own) else -1
        lists[:] = [e for e in lists if e[0] >= 0]

    def matches(self, words: list[bytes]) -> list[tuple[int, float, int, float, float]]:
        """Verified items of a text's words: item id, score of its best verified passage, that passage's first word, overlaps.

        Every retrieved passage is verified, the best first, until one of the item's passes.
        """
        retrieved: dict[int, list[tuple[float, int]]] = {}
        for first, terms in self.passages(words):
            for item, score in self.search(terms, self.spec.least_score):
                retrieved.setdefault(item, []).append((-score, first))
        out = []
        for item, found in retrieved.items():
            key, question, answer = self.items[item]
            for score, first in sorted(found):
                near = words[max(0, first - self.half) : first + 3 * self.half]
                q = overlap(question, near, self.spec.run)
                if q < self.spec.least_question:
                    continue
                a = overlap(answer, near, self.spec.run)
                if a >= self.spec.least_answer:
                    out.append((key, -score, first, q, a))
                    break
        return out


def all_matches(indexes: list[ItemIndex], text: str | None) -> list[tuple[int, float, int, float, float]]:
    words = words_of(text)
    return [match for index in indexes for match in index.matches(words)]


def overlap(part: list[bytes], words: list[bytes], run: int) -> float:
    """Share of the part's runs of ``run`` words (of all its words, where it is shorter) that the words hold; 1 for none."""
    if not part:
        return 1.0
    run = min(run, len(part))
    there = set(zip(*(words[k:] for k in range(run))))
    runs = list(zip(*(part[k:] for k in range(run))))
    return sum(r in there for r in runs) / len(runs)


def find_contamination(docs: DataFrame, items: DataFrame, spec: SearchSpec = SearchSpec(), *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: :data:`MATCHES`. Clean documents have none.

    Whole texts are searched where they are read, without shuffle. Items are indexed ``index_items`` at a time; an
    index is built, broadcast, searched by all documents and dropped before the next, so driver and workers hold one;
    document frequencies are those of all items. Null and empty texts and items match nothing; equal rows match
    alike, each on its own; a null id stays null. Empty tables give an empty result.
    """
    rows_in = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    found = []
    for indexes in index_parts(known, spec):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)
        found.append(settle(_search_all(rows_in, sent)))
        sent.destroy()
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, items: DataFrame, spec: SearchSpec = SearchSpec(), *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, all columns as they are. No shuffle.

    A null or empty text holds nothing and stays; equal rows stay or go alike. Up to ``index_items`` items are
    one filter; more are as many passes, each over what the one before left, settled.
    """
    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    sent = None
    for indexes in index_parts(known, spec):
        if sent is not None:
            docs = settle(docs)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = docs.where(~_holder(sent)(F.col(text)))
    return docs


def _holder(sent: Broadcast) -> Callable[[Column], Column]:
    return map_texts(lambda texts: [bool(all_matches(sent.value, t)) for t in texts], "boolean")


def index_parts(items: DataFrame, spec: SearchSpec) -> Iterator[list[ItemIndex]]:
    """The items (item_id, text) about ``index_items`` at a time, one part at least; null texts are left out.

    Items of a part whose lengths differ by more than four times are indexed apart, so that a long item does not
    widen the passages that short ones are looked for in.
    """
    spark = items.sparkSession
    known = settle(items.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL"))

    def facts(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for content in batch["text"]:
                words = words_of(content)
                terms = list(set(words))
                yield {"term": [*terms, b""], "df": [*[1] * len(terms), len(words)]}

    counted = settle(map_rows(known.select("text"), facts, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df")))
    n_items = known.count()
    parts = max(1, -(-n_items // spec.index_items))
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted((r.item_id is None, r.item_id or 0, r.text) for r in own.collect())
        terms = {t for _, _, content in rows for t in words_of(content)} | {b""}
        asked = spark.createDataFrame([(bytearray(t),) for t in sorted(terms)], "wanted binary")
        frequencies = Counter({bytes(r.term): r.df for r in counted.join(asked, F.col("term") == F.col("wanted"), "left_semi").collect()})
        bands: dict[int, list[tuple[int | None, str]]] = {}
        for null, key, content in rows:
            bands.setdefault(length_band(len(words_of(content))), []).append((None if null else key, content))
        mean = max(1.0, frequencies[b""] / max(1, n_items))
        yield [ItemIndex(bands[b], spec, frequencies, n_items, mean) for b in sorted(bands)]


def length_band(words: int) -> int:
    """0 for up to 64 words, 1 for up to 256, and so on."""
    return max(0, ((words - 1).bit_length() - 5) // 2) if words else 0


def _search_all(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _NAMES}
            for key, content in zip(batch["doc_id"], batch["text"]):
                for match in all_matches(sent.value, content):
                    for name, value in zip(_NAMES, (key, *match)):
                        out[name].append(value)
            yield out

    return map_rows(docs, rows, MATCHES)
