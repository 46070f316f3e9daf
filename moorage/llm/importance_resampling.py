"""Resampling documents towards a target text's distribution of word runs.

Features are hashed runs of one to ``words`` words. The log ratio of the target's and the corpus's smoothed feature
frequencies weighs each feature; a document's weight is the mean over its features. Adding Gumbel noise from a
hash of the document's id and taking the highest sums draws documents without replacement, in proportion to
the exponential of their weights. Features are hashed by :mod:`moorage.llm.position_crc`, many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.llm.base import prepare_workers, settle, to_arrow
from moorage.llm.position_crc import crc32_of_spans

#: Bytes of text whose features are hashed together.
SLICE = 2_000_000
#: Digits and lower-case letters, upper-case letters as lower-case ones, all bytes above ASCII; others separate words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class ResamplingSpec:
    """``percent`` of the documents with at least ``least_words`` words are drawn."""

    words: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def word_bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def feature_buckets(texts: list[str | None], spec: ResamplingSpec) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of the run, text's place in the list, bucket) of every feature, in slices of bounded size whatever a text's length."""
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for place, text in enumerate(texts):
        words = word_bytes(text)
        if words:
            held.append(b" ".join(words))
            owners.append((place, len(words)))
            size += len(held[-1]) + 1
            if size >= SLICE:
                yield from _sliced(held, owners, spec)
                held, owners, size = [], [], 0
    if held:
        yield from _sliced(held, owners, spec)


def _sliced(texts: list[bytes], owners: list[tuple[int, int]], spec: ResamplingSpec) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    flat = np.frombuffer(b" ".join(texts), np.uint8)
    gaps = np.flatnonzero(flat == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(flat))
    owner = np.repeat(*np.array(owners).T)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(flat), SLICE)), len(starts)))
    for begin, stop in zip(cuts[:-1], cuts[1:]):
        for run in range(1, spec.words + 1):
            for shift in range(run):
                # Runs that begin ``run`` words apart do not overlap.
                first = np.arange(begin + shift, min(stop, len(starts) - run + 1), run)
                first = first[owner[first] == owner[first + run - 1]]
                yield run, owner[first], crc32_of_spans(flat, starts[first], ends[first + run - 1]) % np.uint32(spec.buckets)


def bucket_counts(texts: DataFrame, spec: ResamplingSpec) -> np.ndarray:
    """Features of all texts (one string column) by bucket: one short table per task, added up by Spark."""
    kind = to_arrow("bucket int, n bigint")
    prepare_workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(spec.buckets, np.int64)
        for batch in batches:
            for _, _, buckets in feature_buckets(batch.column(0).to_pylist(), spec):
                total += np.bincount(buckets, minlength=spec.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=kind)

    out = np.zeros(spec.buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, of each bucket, rounded down."""
    buckets = len(corpus)
    return np.floor(1000 * np.log((target + 1.0) * (corpus.sum() + buckets) / ((corpus + 1.0) * (target.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, spec: ResamplingSpec) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    kind, sent = to_arrow(schema), docs.sparkSession.sparkContext.broadcast(gain)
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            total, n, words = (np.zeros(size, np.int64) for _ in range(3))
            for length, place, buckets in feature_buckets(batch.column(1).to_pylist(), spec):
                total += np.bincount(place, weights=sent.value[buckets], minlength=size).astype(np.int64)
                n += np.bincount(place, minlength=size)
                if length == 1:
                    words += np.bincount(place, minlength=size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], schema=kind)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value from the id's hash, rounded down; a null id counts as the text ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, spec: ResamplingSpec = ResamplingSpec()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank (null where not drawn).

    ``target`` has a text column. A text without words, or null, has no feature and weight 0, and is never drawn where
    words are asked for. Equal rows draw as rows of their own and score alike; equal scores go by id, a null id last. An empty target or
    corpus gives smoothed frequencies alone; an empty table gives an empty result. Other columns don't matter.

    Scores are whole thousandths in a narrow range whatever the corpus, so counting rows by score finds the last score
    that is drawn; only rows at or above it are sorted, by ranges of score and id, and numbered within their range.
    """
    gain = gains(bucket_counts(docs.select("text"), spec), bucket_counts(target.select("text"), spec))
    scored = settle(weighed(docs, gain, spec).withColumn("score", F.col("weight") + noise(F.col("doc_id"), spec.seed)))
    able = F.col("n_words") >= spec.least_words
    by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = by_score.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))
    number, total = F.floor(F.lit(spec.percent) * F.sum("n").over(Window.partitionBy()) / 100), F.col("upto")
    last = upto.withColumn("number", number).where(total - F.col("n") < F.col("number")).agg(F.min("score").alias("score"), F.max("number").alias("number")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    if last.number is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    near = F.coalesce(able & (F.col("score") >= last.score), F.lit(False))
    drawn = _ranked(scored.where(near).select(*out)).withColumn("rank", F.when(F.col("rank") <= last.number, F.col("rank")))
    return drawn.select(*out, "rank").unionByName(scored.where(~near).select(*out, F.lit(None).cast("bigint").alias("rank")))


#: Bits of a row's number within its partition in ``monotonically_increasing_id``.
_ROW_BITS = 33


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their number by score and id, without a task that sees them all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << _ROW_BITS) - 1) + 1)


def drawn(docs: DataFrame, target: DataFrame, spec: ResamplingSpec = ResamplingSpec()) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ``doc_id`` must tell rows apart."""
    ids = settle(resample(docs, target, spec).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn id")))
    return docs.join(ids, F.col("doc_id") == F.col("drawn id"), "left_semi")
