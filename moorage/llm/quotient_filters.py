"""Exact deduplication with counting quotient filters.

Every text is normalised and gets a fingerprint. A partition's fingerprints go into counting quotient filters, one per
range of fingerprints; the filters of a range are merged by their sorted remainders, which loses nothing: the merged
filter is bit for bit the one of all rows. Fingerprints that a merged filter counts more than once send their texts to
verification, where texts are grouped by all their bytes; all other texts stay where they are.

A filter of ``width``-bit fingerprints splits each into a quotient of q bits and a remainder. The remainders of one
quotient are a run of sorted slots, at the place of the quotient or right behind the run before it. Bit vectors tell
which quotients have a run and which slots end one. A remainder that was met c > 1 times is followed by c - 1 in slots of
its own, low digits first, which a third bit vector marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import may_hold, prepare_workers, settle, to_arrow

#: Bits of a fingerprint.
WIDTH = 48
#: Fingerprints that a task holds before it closes its filters.
HELD = 1 << 20
#: Rows for each range of fingerprints, and the least number of ranges (as a power of two).
RANGE_ROWS, LEAST_RANGE_BITS = 1 << 21, 7


@dataclass(frozen=True)
class CountingQuotientFilter:
    width: int
    quotient_bits: int
    occupied: bytes
    run_ends: bytes
    counters: bytes
    slots: bytes

    @property
    def remainder_bits(self) -> int:
        return self.width - self.quotient_bits


COLUMNS = "width int, quotient_bits int, occupied binary, run_ends binary, counters binary, slots binary"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _bits(places: np.ndarray, size: int) -> bytes:
    marks = np.zeros(size, np.uint8)
    marks[places] = 1
    return np.packbits(marks).tobytes()


def _places(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def build(fingerprints: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
    """The filter of sorted distinct fingerprints below 2**width, each with its count of at least one."""
    quotient_bits = min(width - 1, max(0, int(np.ceil(np.log2(max(1, len(fingerprints)) / 0.9)))))
    remainder_bits = width - quotient_bits
    mask = np.uint64((1 << remainder_bits) - 1)
    more = counts.astype(np.uint64) - np.uint64(1)
    digits = np.zeros(len(more), np.int64)
    left = more.copy()
    while left.any():
        digits += left > 0
        left >>= np.uint64(remainder_bits)
    taken = digits + 1
    ends_of_items = np.cumsum(taken)
    before = ends_of_items - taken

    quotients = (fingerprints >> np.uint64(remainder_bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, quotients[1:] != quotients[:-1])[: len(quotients)])
    lengths = np.add.reduceat(taken, first) if len(first) else taken
    shift = np.maximum.accumulate(quotients[first] - before[first]) if len(first) else first
    run_starts = shift + before[first]
    run_of = np.zeros(len(quotients), np.int64)
    run_of[first[1:]] = 1
    item_starts = shift[np.cumsum(run_of)] + before if len(first) else before

    size = int(run_starts[-1] + lengths[-1]) if len(first) else 0
    slots = np.zeros(size, np.uint64)
    slots[item_starts] = fingerprints & mask
    counters = []
    for k in range(int(digits.max(initial=0))):
        own = np.flatnonzero(digits > k)
        counters.append(item_starts[own] + 1 + k)
        slots[counters[-1]] = more[own] >> np.uint64(k * remainder_bits) & mask
    slot_bytes = -(-remainder_bits // 8)
    return CountingQuotientFilter(
        width,
        quotient_bits,
        _bits(quotients[first], 1 << quotient_bits),
        _bits(run_starts + lengths - 1, size),
        _bits(np.concatenate([np.zeros(0, np.int64), *counters]), size),
        np.ascontiguousarray(slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :slot_bytes]).tobytes(),
    )


def contents(found: CountingQuotientFilter) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a filter and their counts."""
    quotients, ends = _places(found.occupied), _places(found.run_ends)
    if not len(quotients):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.maximum(quotients, np.append(0, ends[:-1] + 1))
    lengths = ends - starts + 1
    upto = np.cumsum(lengths)
    places = np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1])
    slot_bytes = -(-found.remainder_bits // 8)
    wide = np.zeros((len(found.slots) // slot_bytes, 8), np.uint8)
    wide[:, :slot_bytes] = np.frombuffer(found.slots, np.uint8).reshape(-1, slot_bytes)
    values = wide.view("<u8").ravel()[places]
    counter = np.unpackbits(np.frombuffer(found.counters, np.uint8))[places].astype(bool)
    items = np.flatnonzero(~counter)
    digit = np.arange(len(places)) - items[np.cumsum(~counter) - 1] - 1
    added = np.where(counter, values << np.where(counter, digit * found.remainder_bits, 0).astype(np.uint64), np.uint64(0))
    counts = np.add.reduceat(added, items).astype(np.int64) + 1
    return np.repeat(quotients, lengths)[items].astype(np.uint64) << np.uint64(found.remainder_bits) | values[items], counts


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter of all that the filters hold. They may have other numbers of quotients, but must be of one width."""
    parts = [contents(f) for f in filters]
    fingerprints = np.concatenate([p[0] for p in parts])
    order = np.argsort(fingerprints, kind="stable")  # runs that are sorted already
    fingerprints, counts = fingerprints[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])[: len(fingerprints)])
    return build(fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].width)


def partition_filters(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """range, filter columns: of each partition of ``fingerprints`` (one bigint column below 2**WIDTH), without shuffle."""
    schema = f"range int, {COLUMNS}"
    kind, width = to_arrow(schema), WIDTH - range_bits
    prepare_workers(fingerprints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(values, np.arange((1 << range_bits) + 1, dtype=np.uint64) << np.uint64(width))
            low = values & np.uint64((1 << width) - 1)
            for begin in range(0, 1 << range_bits, 1024):
                rows = [
                    (at, *_row(build(low[edges[at] : edges[at + 1]], counts[edges[at] : edges[at + 1]], width)))
                    for at in range(begin, min(begin + 1024, 1 << range_bits))
                    if edges[at] < edges[at + 1]
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().astype(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield from close()
                held = []
        if held:
            yield from close()

    return fingerprints.mapInArrow(run, schema)


def _row(found: CountingQuotientFilter) -> tuple:
    return tuple(getattr(found, name) for name in _NAMES)


def merged_filters(filters: DataFrame) -> DataFrame:
    """One filter for each range. A range holds about ``RANGE_ROWS`` fingerprints, a copy's just once a partition."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = merge([CountingQuotientFilter(*(_plain(v) for v in row)) for row in frame[_NAMES].itertuples(index=False)])
        return pd.DataFrame([(frame["range"].iat[0], *_row(found))], columns=["range", *_NAMES])

    return filters.groupBy("range").applyInPandas(run, f"range int, {COLUMNS}")


def _plain(value):
    return bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else int(value)


def counted(filters: DataFrame) -> DataFrame:
    """fingerprint, n: what the merged filters hold."""
    kind = to_arrow("fingerprint bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = CountingQuotientFilter(*(row[name] for name in _NAMES))
                low, counts = contents(found)
                values = low | np.uint64(row["range"]) << np.uint64(found.width)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts)], schema=kind)

    return filters.mapInArrow(run, "fingerprint bigint, n bigint")


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    # A single space stays as it is, so only other runs are replaced.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _fingerprint(sha256: Column) -> Column:
    return F.conv(F.substring(sha256, 1, WIDTH // 4), 16, 10).cast("bigint")


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the least id of equal texts), group_size (rows), kept, text_sha256.

    Null, empty and white texts are texts as others: null equals empty, white ones equal a single space. Of each group exactly one row is
    kept; rows that repeat the least id are told apart by their place in the table. A null id is the group's
    only if all are null. An empty table gives an empty result. Other columns of ``docs`` don't matter.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), normalised(F.col(text)).alias("normal"))
    digests = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("normal", 256).alias("sha"))
    ids = settle(digests.select("doc_id", "row", _fingerprint(F.col("sha")).alias("fingerprint"), F.unhex("sha").alias("sha")))
    range_bits = max(LEAST_RANGE_BITS, int(np.ceil(np.log2(max(1, ids.count()) / RANGE_ROWS))))
    filters = merged_filters(partition_filters(ids.select("fingerprint"), range_bits))
    repeated = settle(counted(filters).where("n > 1").select(F.col("fingerprint").alias("wanted")))

    # The texts with a repeated fingerprint, and few others, leave their partition; copies in it go as one.
    hashed = rows.withColumn("sha", F.sha2("normal", 256)).withColumn("fingerprint", _fingerprint(F.col("sha")))
    routed = may_hold(hashed, "fingerprint", repeated, "wanted")
    by_bytes = routed.groupBy("normal", "sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = settle(by_bytes.where("group_size > 1").select(F.unhex("sha").alias("of_sha"), "keep_id", "group_size"))

    members = ids.join(classes, F.col("sha") == F.col("of_sha")).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = settle(members.groupBy("of_sha", "keep_id", "group_size").agg(F.min("row").alias("first_row")))
    joined = ids.join(first, F.col("sha") == F.col("of_sha"), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) for each text, all columns as they are: one with the text's least id."""
    kept = exact_duplicates(docs).where("kept")
    keys = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()]
    wanted = settle(kept.select(*(k.alias(f"kept {i}") for i, k in enumerate(keys)), F.col("text_sha256").alias("kept 2")))
    own = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.col("doc_id").isNull(), F.sha2(normalised(F.col("text")), 256)]
    names = [f"kept {i}" for i in range(3)]
    hashed = docs.withColumns(dict(zip(names, own)))
    return hashed.join(wanted, names, "left_semi").dropDuplicates(names).select(*(f"`{c}`" for c in docs.columns))
