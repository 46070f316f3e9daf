"""Token ids in files under a Re-Pair grammar per shard block, with random access to documents.

A block holds the ids of consecutive documents. Its rules each stand for a pair of symbols (ids or earlier
rules); the expansion lengths of all rules are stored, so the place of any id is found without
expanding what stands before it. No rule spans two documents.

Block, all little-endian: header of 8 unsigned 32-bit numbers (magic, symbol bytes, first free symbol, rules,
documents, symbols, flags, 0), rule pairs, rule expansion lengths (u32), documents' symbol counts (u32), documents' id
counts (u32), symbols. Symbols take 2 bytes while ids and rules fit, else 4.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorage.llm.base import map_rows
from moorage.llm.tokens import TokenizerFile, encoder

#: Fixed value: the first bytes of a block.
MAGIC = 0x31_50_52_4D
BLOCKS = "shard int, block int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, grammar binary"
DOCS = "shard int, block int, place int, shard_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
#: Ids gathered before a block is closed; a document is never split, so one above it is a block of its own.
BLOCK_IDS = 2_000_000
_SLOT_BITS = 20


def compress(ids: np.ndarray, lengths: np.ndarray, *, rounds: int = 4, per_round: int = 4096, least: int = 16) -> bytes:
    """A block of the documents whose ids stand one after another in ``ids``.

    Every round counts all pairs within documents, makes rules of the ``per_round`` most frequent ones that
    occur ``least`` times at least, and replaces their occurrences from left to right without overlap. It ends
    after ``rounds``, or when no pair is that frequent.
    """
    symbols = ids.astype(np.uint32)
    full = lengths > 0
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths)[full] - 1] = True
    first_free = int(symbols.max()) + 1 if len(symbols) else 1
    pairs: list[np.ndarray] = [np.zeros((0, 2), np.uint32)]
    free = first_free
    for _ in range(rounds):
        symbols, last, made = _round(symbols, last, free, per_round, least)
        if not len(made):
            break
        pairs.append(made)
        free += len(made)
    rules = np.concatenate(pairs)
    spans = np.ones(free, np.int64)
    for k, (a, b) in enumerate(rules.tolist(), first_free):
        spans[k] = spans[a] + spans[b]
    kept = np.zeros(len(lengths), np.int64)
    kept[full] = np.diff(np.flatnonzero(last), prepend=-1)
    kind = np.dtype("<u2") if free <= 1 << 16 else np.dtype("<u4")
    header = np.array([MAGIC, kind.itemsize, first_free, len(rules), len(lengths), len(symbols), 0, 0], "<u4")
    parts = (header, rules.astype("<u4"), spans[first_free:].astype("<u4"), kept.astype("<u4"), lengths.astype("<u4"), symbols.astype(kind))
    return b"".join(p.tobytes() for p in parts)


def _round(symbols: np.ndarray, last: np.ndarray, free: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and document ends after one round, and the pairs that became rules.

    Pairs are counted in slots. Where unequal pairs share one, the slot's last pair stands for it and the others wait
    for a later round.
    """
    none = np.zeros((0, 2), np.uint32)
    if len(symbols) < 2:
        return symbols, last, none
    slots = ((symbols[:-1] * np.uint32(0x9E3779B1)) ^ (symbols[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - _SLOT_BITS)
    slots[last[:-1]] = 1 << _SLOT_BITS
    slots = slots.astype(np.intp)  # once, not at every use as an index
    counts = np.bincount(slots, minlength=(1 << _SLOT_BITS) + 1)
    counts[-1] = 0
    at = np.flatnonzero((counts >= least)[slots])
    slots = slots[at]
    stands = np.zeros(len(counts), np.int64)
    stands[slots] = at
    # Both symbols of a pair as one number, so that pairs are compared in one go.
    both = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
    standing = np.zeros(len(counts), np.uint64)
    standing[slots] = both
    same = both == standing[slots]
    at, slots = at[same], slots[same]
    counts = np.bincount(slots, minlength=len(counts))
    chosen = np.flatnonzero(counts >= least)
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:most]]
    made = np.stack([symbols[stands[chosen]], symbols[stands[chosen] + 1]], axis=1) if len(chosen) else none
    rule_of = np.full(len(counts), -1, np.int32)
    rule_of[chosen] = np.arange(len(chosen))
    rule = rule_of[slots]
    at, rule = at[rule >= 0], rule[rule >= 0]
    # In a run of overlapping occurrences every second one is replaced, from its left end.
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    within = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
    at, rule = at[within % 2 == 0], rule[within % 2 == 0]
    symbols = symbols.copy()
    symbols[at] = free + rule.astype(np.uint32)
    last = last.copy()
    last[at] = last[at + 1]
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep], last[keep], made


class Block:
    """A block read back: ``ids(d)`` expands one document, ``all_ids()`` all of them, ``id_at`` one place."""

    def __init__(self, data: bytes) -> None:
        magic, width, self.first_free, rules, docs, symbols, _, _ = np.frombuffer(data, "<u4", 8).tolist()
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", rules)
        self.doc_symbols = take("<u4", docs)
        self.doc_lengths = take("<u4", docs)
        self.symbols = take(f"<u{width}", symbols)
        self._ends = np.cumsum(self.doc_symbols, dtype=np.int64)
        self._expansions: tuple[np.ndarray, np.ndarray] | None = None

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions one after another, and where each begins."""
        if self._expansions is None:
            begins = np.zeros(len(self.rules) + 1, np.int64)
            np.cumsum(self.rule_lengths, out=begins[1:])
            flat = np.empty(begins[-1], np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at = begins[k]
                for part in (a, b):
                    if part < self.first_free:
                        flat[at] = part
                        at += 1
                    else:
                        r = part - self.first_free
                        flat[at : at + self.rule_lengths[r]] = flat[begins[r] : begins[r + 1]]
                        at += self.rule_lengths[r]
            self._expansions = flat, begins
        return self._expansions

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self._tables()
        is_rule = symbols >= self.first_free
        source = np.concatenate([np.arange(self.first_free, dtype=np.uint32), flat])
        rule = np.where(is_rule, symbols.astype(np.int64) - self.first_free, 0)
        lengths = np.where(is_rule, self.rule_lengths[rule] if len(self.rules) else 1, 1).astype(np.int64)
        start = np.where(is_rule, begins[rule] + self.first_free, symbols)
        ends = np.cumsum(lengths)
        return source[np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, doc: int) -> np.ndarray:
        end = self._ends[doc]
        return self._expand(self.symbols[end - self.doc_symbols[doc] : end])

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def id_at(self, doc: int, place: int) -> int:
        """One id, by the expansion lengths alone."""
        end = self._ends[doc]
        stack = self.symbols[end - self.doc_symbols[doc] : end].tolist()[::-1]
        while stack:
            s = stack.pop()
            span = 1 if s < self.first_free else int(self.rule_lengths[s - self.first_free])
            if place >= span:
                place -= span
            elif s < self.first_free:
                return s
            else:
                a, b = self.rules[s - self.first_free].tolist()
                stack += [b, a]
        raise IndexError("place beyond the document")


def write_ids(docs: DataFrame, tokenizer: TokenizerFile, path: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write every whole text's ids and ``end_id`` as a table of blocks, in ascending id order.

    Shards are ranges of doc_id (a hash of the text breaks ties, so one id with many rows is no hot key), so
    a shard's place in the order is its number. Spark's writer commits the blocks: a lost task leaves none.
    Null text is empty; null ids come first; equal ids keep their rows, in an order fixed by the texts;
    an empty table makes an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer.text)
    end = int(end_id).to_bytes(4, "little")
    rows_in = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows_in.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def rows(batches):
        from pyspark import TaskContext

        ids = encoder(sent.value).ids
        shard, block, done = TaskContext.get().partitionId(), 0, 0
        keys, parts, held = [], [], 0

        def close():
            nonlocal block, done, keys, parts, held
            every = np.frombuffer(b"".join(parts), "<u4")
            data = compress(every, np.array([len(p) // 4 for p in parts], np.int64))
            out = {"shard": [shard], "block": [block], "shard_start": [done], "n_ids": [held], "doc_ids": [keys], "grammar": [data]}
            block, done = block + 1, done + held
            keys, parts, held = [], [], 0
            return out

        for batch in batches:
            for key, content in zip(batch["doc_id"], batch["text"]):
                data = ids(content or "") + end
                if held and held + len(data) // 4 > block_ids:
                    yield close()
                keys.append(key)
                parts.append(data)
                held += len(data) // 4
        if keys:
            yield close()

    map_rows(ranged, rows, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Blocks are decoded where they are read. A shard's start is the sum of the shards before it: one row per
    shard is summed over, however many documents there are.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def rows(batches):
        for batch in batches:
            for shard, block, start, keys, data in zip(*(batch[c] for c in ("shard", "block", "shard_start", "doc_ids", "grammar"))):
                read = Block(data)
                every = memoryview(read.all_ids().astype("<u4").tobytes())
                counts = read.doc_lengths.astype(np.int64)
                ends = np.cumsum(counts).tolist()
                counts = counts.tolist()
                yield {
                    "shard": [shard] * len(keys),
                    "block": [block] * len(keys),
                    "place": list(range(len(keys))),
                    "shard_start": [start + e - n for e, n in zip(ends, counts)],
                    "doc_id": keys,
                    "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(every[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts)],
                }

    docs = map_rows(blocks, rows, DOCS)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = totals.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("base"))
    joined = docs.join(F.broadcast(before), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
