"""Near-duplicate detection with b-bit MinHash.

Texts that are equal word for word are one class and go on as one. Every class gets minima of its shingle set under
many hash functions. Bands of minima give candidates: classes that share a band's minima are chained, and the chains'
components are the candidate groups. The low bits of the minima, packed, are the class's signature, the only thing that travels
for a candidate: inside a group, counting equal bits estimates every pair's similarity, corrected for chance
agreement. Only texts with a pair that may reach the threshold are fetched, and confirmed on their full shingle sets.
Confirmed links give the components that are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, may_hold, settle, settled_for_now, sorted_distinct, worker_cache
from moorage.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEPT_WORDS = 200_000
_HASHES_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class MinHashSpec:
    """``numerator``/``denominator`` is the similarity that links; bands x rows minima, ``bits`` kept of each.

    A pair at similarity s shares no band with probability (1 - s^rows)^bands: below 6e-6 at 0.8, 7e-9 at 0.85.
    """

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 40
    rows: int = 6
    bits: int = 4
    #: Classes, and shingles of their sets, that are compared at once; larger candidate groups are cut into blocks.
    block: int = 256
    block_shingles: int = 500_000

    @property
    def least(self) -> float:
        """Estimates below this are not confirmed: five standard errors under the threshold."""
        s = self.numerator / self.denominator
        chance = 2.0**-self.bits
        agree = s + (1 - s) * chance
        return s - 5 * np.sqrt(agree * (1 - agree) / (self.bands * self.rows)) / (1 - chance)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, as UTF-8 bytes with A-Z in lower case: what ASCII white space separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Digests(dict):
    """word -> 64-bit digest; a worker keeps those of a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


def _digests() -> _Digests:
    kept = worker_cache("shingles")
    if "words" not in kept:
        kept["words"] = _Digests()
    return kept["words"]


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; a shorter text is one run, none has none."""
    if not words:
        return np.zeros(0, np.uint64)
    digests = np.fromiter(map(_digests().__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + digests[k : len(words) - size + 1 + k])
    return sorted_distinct(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` hash functions over the set, which must not be empty.

    Functions multiply and add modulo 2^32 and look at the high half of the hash and of the product, so low
    bits of the minima are as good as random.
    """
    a, b = _functions(count)
    out = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    base = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    step = max(1, _HASHES_AT_ONCE // count)
    for begin in range(0, len(base), step):
        product = base[begin : begin + step, None] * a
        product += b
        product ^= product >> np.uint32(15)
        np.minimum(out, product.min(axis=0), out=out)
    return out


def packed(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of every minimum, packed one after another."""
    low = (values[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(low.astype(np.uint8)).tobytes()


def estimates(own: np.ndarray, others: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity of one packed signature to each row of others, corrected for agreement by chance.

    Minima agree where all their bits do: the xor of packed bits has no bit in that place.
    """
    differing = np.bitwise_xor(own, others)
    if bits == 4:
        equal = 2 * differing.shape[1] - np.count_nonzero(differing & 0xF0, axis=1) - np.count_nonzero(differing & 0x0F, axis=1) - (2 * differing.shape[1] - count)
    else:
        equal = (~np.unpackbits(differing, axis=1)[:, : count * bits].reshape(len(others), count, bits).any(axis=2)).sum(axis=1)
    chance = 2.0**-bits
    return (equal / count - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, spec: MinHashSpec, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept, text_hash.

    ``kept`` marks the rows whose id is their component's. Texts without words have no shingles and link with
    nothing; each is its own component. Rows with equal ids are one document each for the links, and share the id;
    a null id is never the least one unless all are null. An empty table gives an empty result.

    Copies are counted once (a digest per row, combined before the shuffle), so a text with many copies weighs
    as one. Chains in buckets are as many as rows; a candidate group is compared in blocks of bounded rows and shingles, so
    no task holds a group and no list of pairs is made: tasks return a spanning forest of confirmed links.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    with settled_for_now(spark) as hand_over:
        with settled_for_now(spark) as hand_on:
            signed = settle(_signatures(rows_in, spec))
            ids = hand_on(signed.select("doc_id", "text_hash", "n_shingles", "digest"))
            candidates = hand_on(_candidates(signed))
        linked = settle(components(_links(rows_in, candidates, spec)))
        named = settle(_named(settle(_firsts(ids)), linked))
        joined = ids.join(named, F.col("digest") == F.col("of_digest"), "left")
        component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("of_digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return hand_over(joined.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), "text_hash"))


def first_of_each(docs: DataFrame, spec: MinHashSpec) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) for each component, all columns as they are.

    It is a row with the component's least id; of several such rows the one with the least hash of its text,
    and of equal rows one. Rows without words are components by their ids. Rows that stay are not moved, but for those
    that may share the hash of a row that goes.
    """
    found = near_duplicates(docs, spec)
    first = found.where("kept").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    chosen = settle(_keyed(first).select(*(F.col(c).alias(f"{c} of the first") for c in _KEY)))
    keys = list(chosen.columns)
    times = _keyed(found).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed(dict(zip(_KEY, keys)))
    decided = times.join(chosen.withColumn("is first", F.lit(True)), keys, "left").where("n > 1 OR `is first` IS NULL")
    touched = settle(decided.select(F.col("text_hash of the first").alias("touched")))

    hashed = docs.select("*", *(c.alias(f"{n} of the first") for n, c in _key_of(F.col("doc_id").cast("bigint"), F.xxhash64("text")).items()))
    untouched = may_hold(hashed, "text_hash of the first", touched, "touched", others=True)
    rest = may_hold(hashed, "text_hash of the first", touched, "touched").join(chosen, keys, "left_semi").dropDuplicates(keys)
    columns = [f"`{c}`" for c in docs.columns]
    return untouched.select(*columns).union(rest.select(*columns))


#: What tells rows apart, without nulls: id, whether there is one, hash of the text.
_KEY = ["id", "no_id", "text_hash"]


def _key_of(doc_id: Column, text_hash: Column) -> dict[str, Column]:
    return {"id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull(), "text_hash": text_hash}


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_key_of(F.col("doc_id"), F.col("text_hash")))


def _signatures(docs: DataFrame, spec: MinHashSpec) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the words, band keys, signature: from every whole text, without shuffle."""
    count = spec.bands * spec.rows

    def rows(batches):
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [], "digest": [], "bands": [], "signature": []}
            for text in batch["text"]:
                words = tokens(text)
                hashes = shingles(words, spec.words)
                out["digest"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                out["n_shingles"].append(len(hashes))
                if len(hashes):
                    least = minima(hashes, count)
                    out["signature"].append(packed(least, spec.bits))
                    values = least.reshape(spec.bands, spec.rows).astype(np.uint64)
                    keys = np.arange(spec.bands, dtype=np.uint64)
                    for k in range(spec.rows):
                        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
                    out["bands"].append(keys.astype(np.int64).tolist())
                else:
                    out["bands"].append([])
                    out["signature"].append(None)
            yield out

    return map_rows(docs, rows, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def _firsts(ids: DataFrame) -> DataFrame:
    """digest, doc_id (the least), rows: of every class."""
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"))).alias("first")
    return ids.where("n_shingles > 0").groupBy("digest").agg(first, F.count(F.lit(1)).alias("rows")).select("digest", "first.doc_id", "rows")


def _candidates(signed: DataFrame) -> DataFrame:
    """digest, id, no_id, text_hash (of one row), n_shingles, signature, component: of each class that shares a bucket.

    Classes are nodes by a 64-bit hash of their digest here; two that shared one would just be candidates of each other. The
    least node of a bucket comes from an aggregation that is combined before its shuffle, so a bucket of any size
    is no hot key there; the join back may split it, and only entries of shared buckets take part.
    """
    nodes = signed.where("n_shingles > 0").withColumn("node", F.xxhash64("digest"))
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    ends = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = settle(ends.where("least <> most").select(F.col("bucket").alias("of"), "least"))
    chained = may_hold(entries, "bucket", shared, "of").join(shared, F.col("bucket") == F.col("of")).where("node <> least")
    grouped = settle(components(chained.select(F.col("least").alias("left"), F.col("node").alias("right")).distinct()).withColumnRenamed("node", "of"))
    row = F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash", "n_shingles", "signature")
    classes = may_hold(nodes, "node", grouped, "of").groupBy("digest", "node").agg(F.min(row).alias("row"))
    return settle(classes.select("digest", "node", "row.*")).join(grouped, F.col("node") == F.col("of")).drop("node", "of")


_CELL = ["task", "low", "high"]
_PLACED = "task bigint, low bigint, high bigint, component bigint, own bigint, digest binary, id bigint, no_id boolean, text_hash bigint, n_shingles bigint, signature binary"


def _placed(candidates: DataFrame, spec: MinHashSpec) -> DataFrame:
    """Candidates with the cells (:data:`_CELL`) they are compared in: :data:`_PLACED`.

    Small groups are dealt to cells by hash, many to one. A larger group is cut by set size first: sizes of linked sets differ by
    the similarity at most, so linked classes are in the same or in neighbouring bands of sizes. A band is cut into
    blocks by hash. A cell holds one block, or two that may link.
    """
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    sizes = settle(sizes.withColumnRenamed("component", "of").withColumn("large", (F.col("members") > spec.block) | (F.col("shingles") > spec.block_shingles)))
    held = candidates.join(sizes, F.col("component") == F.col("of")).drop("of", "members", "shingles")
    small = sizes.where("NOT large").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles")).first()
    tasks = 1 + max(small.members // (4 * spec.block), small.shingles // spec.block_shingles)
    none, columns = F.lit(0).cast("bigint"), [c.split()[0] for c in _PLACED.split(", ")]
    dealt = held.where("NOT large").withColumns({"task": F.pmod(F.xxhash64("component"), F.lit(tasks)), "low": none, "high": none, "own": none})

    step = float(np.log(spec.denominator / spec.numerator) * (1 + 1e-9)) or 1.0
    banded = held.where("large").withColumn("band", F.floor(F.log("n_shingles") / step).cast("bigint"))
    rows = F.greatest(F.lit(1), F.least(F.lit(spec.block), F.floor(spec.block_shingles / F.max("n_shingles"))))
    bands = banded.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks"))
    # As many entries as there are bands of sizes, which is the logarithm of the largest.
    plans = settle(bands.groupBy(F.col("component").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("plan")))

    def block(band: Column, part: Column) -> Column:
        return F.shiftleft(band, 40) + part

    cut = banded.join(plans, F.col("component") == F.col("of"))
    cut = cut.withColumn("own", block(F.col("band"), F.pmod(F.xxhash64("digest"), F.col("plan")[F.col("band")])))
    near = F.array(*(F.col("band") + k for k in (-1, 0, 1)))
    blocks = F.transform(
        F.filter(near, lambda b: F.map_contains_key("plan", b)),
        lambda b: F.transform(F.sequence(none, F.col("plan")[b] - 1), lambda part: block(b, part)),
    )
    paired = cut.withColumn("other", F.explode(F.flatten(blocks)))
    paired = paired.withColumns({"task": -F.abs("component") - 1, "low": F.least("own", "other"), "high": F.greatest("own", "other")})
    return dealt.select(*columns).union(paired.select(*columns))


def _links(rows_in: DataFrame, candidates: DataFrame, spec: MinHashSpec) -> DataFrame:
    """left, right: digests of linked classes, a spanning forest of the links inside each cell."""

    def alike(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept = np.zeros(len(frame), bool)
        for i, others in _close(frame, spec):
            kept[i] = True
            kept[others] = True
        return frame[kept]

    def confirmed(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_forest(frame, spec)), columns=["left", "right"])

    likely = settle(_placed(candidates, spec).groupBy(*_CELL).applyInPandas(alike, _PLACED))
    texts = may_hold(_keyed(rows_in).select(*_KEY, "text"), "text_hash", likely, "text_hash").dropDuplicates(_KEY)
    return texts.join(likely, _KEY).select(*(c.split()[0] for c in _PLACED.split(", ")), "text").groupBy(*_CELL).applyInPandas(confirmed, "left binary, right binary")


def _close(frame: pd.DataFrame, spec: MinHashSpec) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell, each with earlier ones of its component that it may be linked with, by signature and size."""
    count = spec.bands * spec.rows
    component, own, sizes = (frame[c].to_numpy() for c in ("component", "own", "n_shingles"))
    signatures = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), -1)
    across = frame["low"].iat[0] != frame["high"].iat[0]  # pairs inside one block belong to that block's own cell
    order = np.lexsort((sizes, component))
    starts = np.flatnonzero(np.append(True, np.diff(component[order]) != 0))
    for group in np.split(order, starts[1:]):
        held, size = signatures[group], sizes[group]
        # Smaller sets come first; those too small for the threshold are passed over.
        begin = np.searchsorted(spec.denominator * size, spec.numerator * size)
        for k in range(1, len(group)):
            if begin[k] < k:
                close = group[begin[k] + np.flatnonzero(estimates(held[k], held[begin[k] : k], count, spec.bits) >= spec.least)]
                if across:
                    close = close[own[close] != own[group[k]]]
                if len(close):
                    yield int(group[k]), close


def _forest(frame: pd.DataFrame, spec: MinHashSpec) -> Iterator[tuple[bytes, bytes]]:
    digests, texts = frame["digest"].tolist(), frame["text"].tolist()
    sets: dict[int, np.ndarray] = {}
    root = list(range(len(frame)))

    def held(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(tokens(texts[i]), spec.words)
        return sets[i]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, others in _close(frame, spec):
        for j in others.tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(held(i), held(j), assume_unique=True))
            if spec.denominator * both >= spec.numerator * (len(held(i)) + len(held(j)) - both):
                root[a] = b
                yield digests[j], digests[i]


def _named(firsts: DataFrame, linked: DataFrame) -> DataFrame:
    """of_digest, component_id (the least id) of classes that are linked or have copies."""
    in_links = settle(firsts.join(linked, F.col("digest") == F.col("node")).select("digest", "doc_id", "component"))
    roots = settle(in_links.groupBy(F.col("component").alias("root")).agg(F.min("doc_id").alias("component_id")))
    named = in_links.join(roots, F.col("component") == F.col("root")).select(F.col("digest").alias("of_digest"), "component_id")
    copies = firsts.where("rows > 1").join(linked, F.col("digest") == F.col("node"), "left_anti")
    return named.union(copies.select("digest", "doc_id"))
