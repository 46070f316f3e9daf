"""Byte model by context-tree weighting, and scores of whole texts with it.

A text is a stream of bytes: its words (A-Z in lower case) joined by a space, and a line feed as its end. Each byte is
eight binary decisions, and each decision has a context tree of its own over the up to ``depth`` bytes before it,
across words (spaces before a text's first byte). A node's estimate is Krichevsky-Trofimov's from its training
counts; its weight against its children follows from the block probabilities,

    Pw = 1/2 Pe + 1/2 prod Pw(children),   Pw = Pe at a leaf,

so a byte's probability mixes the estimates of all depths on its path. Every context with a training byte has its node, at
every depth: the tree grows with the corpus and stays in tables.

A gram is a byte with the context before it, written nearest byte first, so that a subtree is a range of grams. Buckets are
such ranges, with about as many bytes of text each: where many bytes follow one context, it is cut by the byte before it, and
so on. A task counts the grams of its chunk and sends them in one piece per bucket. A bucket adds up its pieces and
weighs its subtrees from the leaves up; the nodes above the buckets are weighed by groups with the same last two bytes, and the
few nodes above those on the driver. Then buckets
answer every piece with its grams' log-probabilities in the same order, and chunks sum them per text. Words are
counted the same way for the unigram base.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, settle, small_batches, sorted_distinct, to_arrow
from moorage.llm.bbit_minhash import tokens

#: Bytes of text in one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Positions of a stream that are looked at together.
SLICE = 2_000_000
#: Bytes of text whose grams share a bucket: at most, at least, and the buckets of a small corpus.
BUCKET_BYTES, SMALL_BUCKET_BYTES, FEW_BUCKETS = 4_000_000, 250_000, 64
#: One in so many positions is a sample for the cut into buckets; it comes from so many chunks at most.
SAMPLE_STEP, SAMPLE_CHUNKS = 4096, 2000
_SPACE, _END = 0x20, 0x0A


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data))


#: Counts up to which ln Gamma is looked up.
_TABLED = 1 << 14


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2: Stirling's series eight further on."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.astype(np.float64)
    for k in range(1, 8):
        product = product * (x + k)
    return out - np.log(product)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    counts = np.arange(_TABLED, dtype=np.float64)
    return _log_gamma(counts + 0.5), _log_gamma(counts + 1.0)


def _looked_up(counts: np.ndarray, which: int) -> np.ndarray:
    """ln Gamma of the counts and 1/2, or 1."""
    out = _tables()[which][np.minimum(counts, _TABLED - 1)]
    large = np.flatnonzero(counts >= _TABLED)
    out[large] = _log_gamma(counts[large] + (0.5, 1.0)[which])
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _looked_up(zeros, 0) + _looked_up(ones, 0) - math.log(math.pi) - _looked_up(zeros + ones, 1)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return _squeeze(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(_expand(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_grams(grams: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=np.uint64(0)))


def _unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def stream_grams(flat: np.ndarray, depth: int, begin: int, stop: int) -> np.ndarray:
    """Grams of the bytes ``begin`` to ``stop`` of texts one after another; before a text's first byte are spaces.

    The byte is the lowest of the number, the nearest one before it the highest.
    """
    grams = flat[begin:stop].astype(np.uint64)
    ended = np.zeros(stop - begin, bool)
    for back in range(1, depth + 1):
        outside = min(max(0, back - begin), stop - begin)
        byte = np.full(stop - begin, _SPACE, np.uint8)
        byte[outside:] = flat[begin + outside - back : stop - back]
        ended |= byte == _END
        byte[ended] = _SPACE
        grams |= byte.astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return grams


def grams_at(flat: np.ndarray, depth: int, places: np.ndarray) -> np.ndarray:
    """The same for single places."""
    grams = flat[places].astype(np.uint64)
    ended = np.zeros(len(places), bool)
    for back in range(1, depth + 1):
        byte = flat[np.maximum(places - back, 0)]
        ended |= (byte == _END) | (places < back)
        byte[ended] = _SPACE
        grams |= byte.astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return grams


def _shorter(grams: np.ndarray) -> np.ndarray:
    """The same bytes with contexts a byte shorter."""
    return (grams >> np.uint64(16)) << np.uint64(8) | grams & np.uint64(255)


def _slices(size: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, size, SLICE):
        yield begin, min(size, begin + SLICE)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _collapse(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of the parts, with their counts added up."""
    grams = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    order = np.argsort(grams)
    grams = grams[order]
    first = _starts(grams)
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _counted(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(g) for g, _ in held[1:]) > max(SLICE, len(held[0][0])):
            held = [_collapse(held)]
    return _collapse(held)


def count_grams(flat: np.ndarray, depth: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of texts one after another, with their counts in texts marked by ``train``, one per text."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text = 0
        for begin, stop in _slices(len(flat)):
            ends = flat[begin:stop] == _END
            learned = train[np.minimum(text + np.cumsum(ends) - ends, len(train) - 1)]
            text += int(ends.sum())
            marked = np.sort(stream_grams(flat, depth, begin, stop) << np.uint64(1) | learned)
            grams = marked >> np.uint64(1)
            first = _starts(grams)
            yield grams[first], np.add.reduceat(marked & np.uint64(1), first).astype(np.int64)

    return _counted(parts())


def score_stream(flat: np.ndarray, depth: int, logs: np.ndarray) -> np.ndarray:
    """log2 probability of each text of a stream; ``logs`` are those of its sorted distinct grams."""
    sliced = []
    for begin, stop in _slices(len(flat)):
        grams = stream_grams(flat, depth, begin, stop)
        order = np.argsort(grams)
        grams = grams[order]
        first = _starts(grams)
        sliced.append((order.astype(np.int32), first, grams[first]))
    known = sorted_distinct(np.concatenate([np.zeros(0, np.uint64), *(g for _, _, g in sliced)]))
    value = np.empty(len(flat), np.float64)
    for (begin, stop), (order, first, grams) in zip(_slices(len(flat)), sliced):
        value[begin:stop][order] = np.repeat(logs[np.searchsorted(known, grams)], np.diff(first, append=stop - begin))
    ends = np.flatnonzero(flat == _END)
    return np.add.reduceat(value, np.append(0, ends[:-1] + 1)) if len(ends) else np.zeros(0)


@dataclass(frozen=True)
class Plan:
    """Buckets of grams: each begins at ``lows`` and holds the subtrees of contexts of ``roots`` bytes."""

    lows: np.ndarray
    roots: np.ndarray


def plan_buckets(sample: np.ndarray, depth: int, most: float) -> Plan:
    """Buckets of at most about ``most`` of the sorted sampled grams.

    A context with more is cut by the byte before it, as long as its parts stay inner nodes; other contexts with the
    same bytes after them share a bucket while they are few.
    """
    lows, roots = [], []

    def cut(prefix: int, length: int, own: np.ndarray) -> None:
        shift = 8 * (depth - length)
        edges = np.searchsorted(own, np.array([prefix + (b << shift) for b in range(256)], np.uint64))
        counts = np.diff(edges, append=len(own))
        begin, held = 0, 0
        for byte in range(257):
            n = int(counts[byte]) if byte < 256 else 0
            deeper = n > most and length + 2 < depth
            if byte > begin and (byte == 256 or deeper or held + n > most):
                lows.append(prefix + (begin << shift))
                roots.append(length + 1)
                begin, held = byte, 0
            if byte < 256 and deeper:
                cut(prefix + (byte << shift), length + 1, own[edges[byte] : edges[byte] + n])
                begin = byte + 1
            held += n if not deeper else 0

    if depth == 1:
        return Plan(np.zeros(1, np.uint64), np.zeros(1, np.int64))
    cut(0, 0, sample)
    return Plan(np.array(lows, np.uint64), np.array(roots, np.int64))


@dataclass
class Level:
    """Grams of one context length, in order, and their counts; ``up``: each one's place in the next shorter level.

    ``given``: rows whose children were weighed elsewhere, and ln of those children's Pw products, per decision.
    """

    grams: np.ndarray
    counts: np.ndarray
    up: np.ndarray | None = None
    given: tuple[np.ndarray, np.ndarray] | None = None


def _levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels for contexts of ``depth`` bytes, one less, and so on to ``least``."""
    levels = []
    for _ in range(depth - least):
        shorter, up = np.unique(_shorter(grams), return_inverse=True)
        levels.append(Level(grams, counts, up))
        grams, counts = shorter, np.bincount(up, weights=counts, minlength=len(shorter)).astype(np.int64)
    return [*levels, Level(grams, counts)]


def products(levels: list[Level]) -> Iterator[np.ndarray]:
    """For each of the eight decisions, ln of the children's Pw product at the last level, which is not weighed itself."""
    for bit in range(8):
        product = None
        for level, after in zip(levels, levels[1:]):
            product = _passed_on(level, after, bit, *_node(level, bit, product)[:2])
        yield product


def _node(level: Level, bit: int, product: np.ndarray | None) -> tuple:
    """Of a level's nodes for a decision: first rows, ln Pw; and of its rows: estimate, weight, whether any byte was seen."""
    if level.given is not None:
        rows, given = level.given
        product = np.zeros(len(level.grams)) if product is None else product
        product[rows] = given[bit]
    node = level.grams >> np.uint64(8 - bit)
    first = _starts(node)
    value = level.grams >> np.uint64(7 - bit) & np.uint64(1)
    total, ones = (np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64) for c in (level.counts, np.where(value, level.counts, 0)))
    log_pe = _log_kt(total - ones, ones)
    if product is None:
        log_pw, weight = log_pe, np.ones(len(first))
    else:
        children = product[first]
        log_pw = np.logaddexp(log_pe, children) - math.log(2)
        weight = 1 / (1 + np.exp(np.clip(children - log_pe, -500, 500)))
    return first, log_pw, weight, total, ones, value


def decide(levels: list[Level], above: np.ndarray | None, every: bool) -> Iterator[list[np.ndarray]]:
    """For each of the eight decisions the mixtures at ``every`` level, or the last part of the first level's alone.

    The first level has the leaves, but for rows with ``given`` products. ``above`` (8, 3, rows): the mixture at the last
    level from the contexts before it; the last level is then weighed there, not here. The mixture has
    three parts: what the estimates down to here bring, the weight left for deeper ones, and the probability where no
    deeper context has a training byte.
    """
    weighed = levels if above is None else levels[:-1]
    for bit in range(8):
        nodes, product = [], None
        for k, level in enumerate(weighed):
            first, log_pw, weight, total, ones, value = _node(level, bit, product)
            own = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(level.grams)))
            estimate = (np.where(value, ones[own], (total - ones)[own]) + 0.5) / (total + 1.0)[own]
            nodes.append((estimate, weight[own], (total > 0)[own]))
            if k + 1 < len(levels):
                product = _passed_on(level, levels[k + 1], bit, first, log_pw)
        last = len(levels[-1].grams)
        mixed = np.stack([np.zeros(last), np.ones(last), np.full(last, 0.5)]) if above is None else above[bit].astype(np.float64)
        mixtures = []
        for level in reversed(weighed):
            estimate, weight, seen = nodes.pop()
            brought, left, stop = mixed if level.up is None else mixed[:, level.up]
            own = left * estimate
            stop = np.where(seen, brought + own, stop)
            if not every and not nodes:
                yield [stop]
                break
            mixed = np.stack([brought + own * weight, left * (1 - weight), stop])
            mixtures.append(mixed)
        else:
            yield mixtures[::-1]


def _passed_on(level: Level, after: Level, bit: int, first: np.ndarray, log_pw: np.ndarray) -> np.ndarray:
    """For each row of the level after, the sum of ln Pw of its node's children."""
    prefix = after.grams >> np.uint64(8 - bit)
    starts = _starts(prefix)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(prefix)))
    return np.bincount(group[level.up[first]], weights=log_pw, minlength=len(starts))[group]


def subtree_products(grams: np.ndarray, counts: np.ndarray, depth: int, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the nodes above a bucket need of it: its grams with ``root`` bytes of context, counts, products of Pw (8, rows)."""
    levels = _levels(grams, counts, depth, root)
    return levels[-1].grams, levels[-1].counts, np.stack(list(products(levels)))


#: What buckets tell of their roots, by the length of these: grams, counts, products of Pw.
Tops = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def given_levels(tops: Tops, least: int) -> list[Level]:
    """Levels from the longest roots to contexts of ``least`` bytes, with what buckets tell at each."""
    levels: list[Level] = []
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for length in range(max(tops), least - 1, -1):
        own, own_counts, told = tops.get(length, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((8, 0))))
        both = np.concatenate([grams, own])
        order = np.argsort(both)
        if levels:
            levels[-1].up = np.argsort(order)[levels[-1].up]
        rows = np.flatnonzero(order >= len(grams))
        level = Level(both[order], np.concatenate([counts, own_counts])[order], given=(rows, told[:, order[rows] - len(grams)]))
        levels.append(level)
        if length > least:
            grams, level.up = np.unique(_shorter(level.grams), return_inverse=True)
            counts = np.bincount(level.up, weights=level.counts, minlength=len(grams)).astype(np.int64)
    return levels


def weigh_top(tops: Tops, above: tuple[np.ndarray, np.ndarray] | None = None, least: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and mixtures (8, 3, rows) at the buckets' roots, by the length of these.

    ``above``: grams and mixtures at contexts of ``least`` bytes, where the nodes above those were weighed elsewhere.
    """
    levels = given_levels(tops, least)
    begun = None if above is None else above[1][:, :, np.searchsorted(above[0], levels[-1].grams)]
    mixtures = list(decide(levels, begun, True))
    out = {}
    for k, level in enumerate(levels if above is None else levels[:-1]):
        rows = level.given[0]
        if len(rows):
            out[max(tops) - k] = level.grams[rows], np.stack([m[k][:, rows] for m in mixtures]).astype(np.float32)
    return out


def weigh_bucket(grams: np.ndarray, counts: np.ndarray, depth: int, root: int, top_grams: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log2 probability of each of a bucket's grams."""
    levels = _levels(grams, counts, depth, root)
    above = top[:, :, np.searchsorted(top_grams, levels[-1].grams)]
    return sum(np.log2(stop) for stop, in decide(levels, above, False))


TEXTS = "chunk bigint, bytes bigint, n_learned bigint, text binary, ids binary, flags binary, sample binary"
#: What a text's flag says, added up.
_HELD_OUT, _NO_ID = 1, 2


def _chunks(docs: DataFrame, depth: int) -> DataFrame:
    """Texts in chunks, each as one stream, with their ids and flags and a sample of their grams. No shuffle."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bool, bytes]] = []
        size = 0

        def close() -> dict:
            whole = b"".join(text for _, _, text in held)
            flags = bytes((_HELD_OUT if out else 0) + (_NO_ID if key is None else 0) for key, out, _ in held)
            sample = grams_at(np.frombuffer(whole, np.uint8), depth, np.arange(0, len(whole), SAMPLE_STEP))
            values = (part << 32 | number, len(whole), sum(not out for _, out, _ in held), _squeeze(whole), np.array([key or 0 for key, _, _ in held], "<i8").tobytes(), flags, sample.tobytes())
            return {c.split()[0]: [v] for c, v in zip(TEXTS.split(", "), values)}

        for batch in batches:
            for key, text, held_out in zip(batch["doc_id"], batch["text"], batch["held_out"]):
                held.append((key, held_out, stream(tokens(text))))
                size += len(held[-1][2]) + 100
                if size >= CHUNK_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return map_rows(docs, rows, TEXTS)


class _Numbers(dict):
    """word -> its number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _numbered(whole: bytes, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a stream by bucket, its words by their places among them, words of each text, and where buckets begin."""
    sizes = np.array([text.count(b" ") + 1 if text else 0 for text in whole[:-1].split(b"\n")], np.int64)
    numbers = _Numbers()
    flat = np.fromiter(map(numbers.__getitem__, whole.split()), np.uint32, int(sizes.sum()))
    words = list(numbers)
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words))
    return [words[i] for i in order.tolist()], place[flat], sizes, np.searchsorted(bucket[order], np.arange(buckets + 1))


PIECES = "kind int, bucket int, chunk bigint, asked binary, counts binary"
_WORDS, _GRAMS = 0, 1


def _pieces(texts: DataFrame, plan: Plan, depth: int) -> DataFrame:
    """Distinct words and grams of each chunk, by bucket, with their counts in texts that are learned from."""
    kind = to_arrow(PIECES)
    buckets = len(plan.lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for chunk, text, flags in zip(*(batch.column(c).to_pylist() for c in ("chunk", "text", "flags"))):
                whole = _expand(text)
                train = np.frombuffer(flags, np.uint8) & _HELD_OUT == 0
                words, places, sizes, edges = _numbered(whole, buckets)
                counts = np.bincount(places[np.repeat(train, sizes)], minlength=len(words))
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[b], edges[b + 1])
                    rows.append((_WORDS, b, chunk, _squeeze(b"\n".join(words[own])), _pack(counts[own].astype("<i8"))))
                del words, places
                grams, counts = count_grams(np.frombuffer(whole, np.uint8), depth, train)
                edges = np.append(np.searchsorted(grams, plan.lows), len(grams))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[b], edges[b + 1])
                    rows.append((_GRAMS, b, chunk, _pack_grams(grams[own]), _pack(counts[own].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return texts.select("chunk", "text", "flags").mapInArrow(run, PIECES)


#: A bucket's distinct words or grams with their counts, what the top needs of it, and what each chunk asks.
BUCKETS = "kind int, bucket int, n bigint, v bigint, keys binary, counts binary, top binary, top_counts binary, products binary, chunks array<bigint>, asked array<binary>"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
ANSWERS = "chunk bigint, kind int, bucket int, answer binary"


def _summed(frame: pd.DataFrame, plan: Plan, depth: int) -> pd.DataFrame:
    kind, bucket = int(frame["kind"].iat[0]), int(frame["bucket"].iat[0])
    asked = (frame["chunk"].tolist(), frame["asked"].tolist())
    if kind == _WORDS:
        total: dict[bytes, int] = {}
        for words, counts in zip(frame["asked"], frame["counts"]):
            for word, count in zip(_expand(words).split(b"\n"), _unpack(counts, "<i8").tolist()):
                total[word] = total.get(word, 0) + count
        sums = np.fromiter(total.values(), np.int64, len(total))
        row = (kind, bucket, int(sums.sum()), int((sums > 0).sum()), _squeeze(b"\n".join(total)), _pack(sums.astype("<i8")), None, None, None, *asked)
    else:
        own, counts = _counted((_unpack_grams(a), _unpack(b, "<u4").astype(np.int64)) for a, b in zip(frame["asked"], frame["counts"]))
        top, top_counts, told = subtree_products(own, counts, depth, int(plan.roots[bucket]))
        row = (kind, bucket, None, None, _pack_grams(own), _pack(counts.astype("<i8")), *_packed_top(top, top_counts, told), *asked)
    return pd.DataFrame([row], columns=[c.split()[0] for c in BUCKETS.split(", ")]).astype({"n": "Int64", "v": "Int64"})


#: Bytes of context at which the nodes of one group end that is weighed in a task; the driver weighs those above.
MIDDLE = 2
#: Bytes of mixtures at the roots of deeper buckets up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 64 << 20
_TOLD = ["bucket", "top", "top_counts", "products"]


def _told(rows: Iterable, plan: Plan) -> Tops:
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for bucket, top, counts, products_ in rows:
        length = MIDDLE if bucket is None else int(plan.roots[bucket])
        parts.setdefault(length, []).append((_unpack_grams(top), _unpack(counts, "<i8"), _unpack(products_, "<f8").reshape(-1, 8).T))
    return {length: tuple(np.concatenate(c, axis=-1) for c in zip(*own)) for length, own in parts.items()}


def _packed_top(grams: np.ndarray, counts: np.ndarray, products_: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return _pack_grams(grams), _pack(counts.astype("<i8")), _pack(np.ascontiguousarray(products_.T).astype("<f8").ravel())


def _mixtures(buckets: DataFrame, plan: Plan, depth: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], DataFrame | None]:
    """Mixtures at the roots of all buckets: those of short roots, and a table (of_bucket, roots, mixture) of longer ones' or none.

    Longer roots are weighed in groups with the same last ``MIDDLE`` bytes. What reaches the driver is a row per byte and
    context of that many bytes, which the alphabet bounds and not the corpus.
    """
    told = buckets.where(F.col("kind") == _GRAMS).select(*_TOLD)
    deep = np.flatnonzero(plan.roots > MIDDLE)
    rows = [tuple(r) for r in told.where(~F.col("bucket").isin(deep.tolist())).collect()] if len(deep) else [tuple(r) for r in told.collect()]
    if not len(deep):
        return (weigh_top(_told(rows, plan)) if rows else {}), None
    shift = 8 * (depth + 1 - MIDDLE)
    groups = buckets.sparkSession.createDataFrame([(int(b), int(plan.lows[b]) >> shift) for b in deep.tolist()], "of int, shared int")
    grouped = settle(told.join(groups, F.col("bucket") == F.col("of")).select("shared", *_TOLD)).groupBy("shared")

    def middle(frame: pd.DataFrame) -> pd.DataFrame:
        levels = given_levels(_told(frame[_TOLD].itertuples(index=False), plan), MIDDLE)
        row = _packed_top(levels[-1].grams, levels[-1].counts, np.stack(list(products(levels))))
        return pd.DataFrame([row], columns=_TOLD[1:])

    rows += [(None, *r) for r in grouped.applyInPandas(middle, "top binary, top_counts binary, products binary").collect()]
    short = weigh_top(_told(rows, plan))
    sent = buckets.sparkSession.sparkContext.broadcast(short[MIDDLE])

    def downwards(frame: pd.DataFrame) -> pd.DataFrame:
        own = [tuple(r) for r in frame[_TOLD].itertuples(index=False)]
        found = weigh_top(_told(own, plan), sent.value, MIDDLE)
        out = []
        for bucket, top, _, _ in own:
            grams, mixed = found[int(plan.roots[bucket])]
            mine = mixed[:, :, np.searchsorted(grams, _unpack_grams(top))]
            out.append((bucket, top, _pack(np.ascontiguousarray(mine).astype("<f4").ravel())))
        return pd.DataFrame(out, columns=["of_bucket", "roots", "mixture"])

    return short, settle(grouped.applyInPandas(downwards, "of_bucket int, roots binary, mixture binary"))


def _answers(buckets: DataFrame, plan: Plan, depth: int) -> DataFrame:
    """To each piece, its words' training counts or its grams' log2 probabilities, in the piece's order."""
    short, long = _mixtures(buckets, plan, depth)
    kind, sent = to_arrow(ANSWERS), buckets.sparkSession.sparkContext.broadcast(short)
    asked = buckets.select("kind", "bucket", "keys", "counts", "chunks", "asked")
    if long is None:
        asked = asked.withColumns({"roots": F.lit(None).cast("binary"), "mixture": F.lit(None).cast("binary")})
    else:
        size = long.agg(F.sum(F.octet_length("roots") + F.octet_length("mixture"))).first()[0]
        own = (F.col("bucket") == F.col("of_bucket")) & (F.col("kind") == _GRAMS)
        asked = asked.join(F.broadcast(long) if size <= MOST_BROADCAST else long, own, "left").drop("of_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                counts, out = _unpack(row["counts"], "<i8"), []
                if row["kind"] == _WORDS:
                    total = dict(zip(_expand(row["keys"]).split(b"\n"), counts.tolist()))
                    out = [_pack(np.array([total[w] for w in _expand(a).split(b"\n")], "<i8")) for a in row["asked"]]
                else:
                    own, root = _unpack_grams(row["keys"]), int(plan.roots[row["bucket"]])
                    if row["roots"] is None:
                        roots, mixture = sent.value[root]
                    else:
                        roots = _unpack_grams(row["roots"])
                        mixture = _unpack(row["mixture"], "<f4").reshape(8, 3, -1)
                    logs = weigh_bucket(own, counts, depth, root, roots, mixture).astype("<f4")
                    out = [_pack(logs[np.searchsorted(own, _unpack_grams(a))]) for a in row["asked"]]
                n = len(out)
                columns = (row["chunks"], [row["kind"]] * n, [row["bucket"]] * n, out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    return asked.mapInArrow(run, ANSWERS)


def score_documents(docs: DataFrame, *, depth: int = 6) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, held_out): tokens, known tokens, unigram and tree log10 scores.

    Learns from rows that are not held out, counting every byte of every text. A null text is empty and has the
    end alone. Equal rows each get their row; null ids stay. Where nothing is learned from, every count is zero and all
    decisions have probability 1/2. An empty table gives an empty result. A gram and a mark are one 64-bit number, so
    contexts have 6 bytes at most.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a depth of 1 to 6 bytes")
    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    texts = settle(_chunks(rows_in, depth))
    size, n_ends = texts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "n_learned"))).first()
    # A sample decides where buckets begin, and so how work is spread; results are the same with any.
    chosen = texts.orderBy(F.xxhash64("chunk")).limit(SAMPLE_CHUNKS).select("sample").collect()
    sample = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.sample, np.uint64) for r in chosen)]))
    share = min(BUCKET_BYTES, max(SMALL_BUCKET_BYTES, size // FEW_BUCKETS)) / max(1, size)
    plan = plan_buckets(sample, depth, share * len(sample))

    def summed_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        return _summed(frame, plan, depth)

    dealt = _pieces(texts, plan, depth).repartition(len(plan.lows), "kind", "bucket")
    buckets = settle(dealt.groupBy("kind", "bucket").applyInPandas(summed_bucket, BUCKETS))
    seen = buckets.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    n, v = seen.n + n_ends, seen.v + (n_ends > 0)
    answers = _answers(buckets, plan, depth)
    norm, word_buckets = math.log10(n + v + 1), len(plan.lows)

    def summed(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        whole = _expand(wanted["text"].iat[0])
        flags = np.frombuffer(wanted["flags"].iat[0], np.uint8)
        ids = np.frombuffer(wanted["ids"].iat[0], "<i8")
        found = found.sort_values("bucket")
        counts = np.concatenate([np.zeros(0, "<i8"), *(_unpack(x, "<i8") for x in found.loc[found["kind"] == _WORDS, "answer"])])
        logs = np.concatenate([np.zeros(0, "<f4"), *(_unpack(x, "<f4") for x in found.loc[found["kind"] == _GRAMS, "answer"])])
        scores = score_stream(np.frombuffer(whole, np.uint8), depth, logs) * math.log10(2)
        plain = np.log10(counts + 1.0) - norm
        _, places, sizes, _ = _numbered(whole, word_buckets)
        ends = np.append(0, np.cumsum(sizes))
        known_words = np.diff(np.append(0, np.cumsum(counts[places] > 0))[ends]) + (n_ends > 0)
        out = []
        for k, (key, flag, score) in enumerate(zip(ids.tolist(), flags.tolist(), scores.tolist())):
            base = float(plain[places[ends[k] : ends[k + 1]]].sum()) + math.log10(n_ends + 1) - norm
            out.append((None if flag & _NO_ID else key, bool(flag & _HELD_OUT), int(sizes[k]) + 1, int(known_words[k]), n, base, score))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")]).astype({"doc_id": "Int64"})

    return answers.groupBy("chunk").cogroup(texts.select("chunk", "text", "ids", "flags").groupBy("chunk")).applyInPandas(summed, SCORES)
