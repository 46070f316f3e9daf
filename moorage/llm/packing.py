"""Packing documents into sequences: best fit, then local search by swaps."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, settle
from moorage.llm.tokens import TokenizerFile, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = PIECES + ", sequence_id bigint, offset bigint"
#: Pieces that are packed together; groups are dealt by hash, so all have about this size.
GROUP_PIECES = 16_384


def cut(docs: DataFrame, tokenizer: TokenizerFile, *, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text and ``end_id``, cut into pieces of ``capacity``; the first takes the rest.

    Null text is empty and gives one piece with the end id alone. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer.text)
    end = int(end_id).to_bytes(4, "little")

    def rows(batches):
        ids = encoder(sent.value).ids
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for key, content in zip(batch["doc_id"], batch["text"]):
                data = memoryview(ids(content or "") + end)
                total = len(data) // 4
                start, number = 0, 0
                while start < total:
                    stop = start + capacity if number else (total - 1) % capacity + 1
                    for name, value in zip(out, (key, number, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]))):
                        out[name].append(value)
                    start, number = stop, number + 1
            yield out

    return map_rows(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), rows, PIECES)


def pack(pieces: DataFrame, *, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a sequence and a place in it; sequences hold ``capacity`` at most, without gaps.

    Pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed on its own by
    :func:`pack_lengths`, so a task's memory is bounded and the loss is under one sequence per group.
    ``pieces`` should be a settled table, as it is read twice (once for the count). Copies and null ids are
    told apart by their row's place in the group; an empty table gives an empty result.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [c.split()[0] for c in PLACES.split(", ")]

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # The order is fixed by the rows themselves: a task that runs again packs alike.
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins = pack_lengths(frame["length"].tolist(), capacity)
        sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        for number, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = number, at
                at += int(frame["length"].iat[i])
        return frame.assign(sequence_id=int(key[0]) * 2**32 + sequence, offset=offset)[names]

    spread = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return spread.groupBy("group").applyInPandas(place, PLACES)


def pack_lengths(lengths: Sequence[int], capacity: int, *, tries: int | None = None) -> list[list[int]]:
    """Bins of indexes into ``lengths``, which must not rise: best fit, then :func:`empty_bins`."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        left = room - length
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    return empty_bins(bins, lengths, capacity, tries=tries)


def empty_bins(bins: list[list[int]], lengths: Sequence[int], capacity: int, *, tries: int | None = None) -> list[list[int]]:
    """Local search among underfull bins: every step raises the sum of squared fills.

    The emptiest bin gives: each of its items moves to another bin with room, or changes places with one
    shorter item, or with two that are together shorter, of a fuller bin. Fuller bins get fuller, the giving
    bin emptier, and a bin without items goes. A round takes every underfull bin once as the giving one, emptiest
    first. The search ends with a round that changes nothing, or when all room left is less than a bin;
    ``tries``, if given, also ends it after as many steps looked for.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed and tries != 0:
        changed = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        spare = sum(capacity - fill[b] for b in under)
        if spare < capacity:
            break
        takers = _Takers(capacity)
        for b in under:
            takers.add(b, capacity - fill[b], [lengths[i] for i in bins[b]])
        for giver in under:
            if spare < capacity or tries == 0:
                break
            if fill[giver] == capacity:
                continue
            takers.remove(giver)
            for i in sorted(bins[giver], key=lambda i: -lengths[i]):
                if tries == 0:
                    break
                tries = None if tries is None else tries - 1
                found = takers.best(lengths[i])
                if found is None:
                    continue
                b, back = found
                handed = _of_length(back, bins[b], lengths)
                bins[giver].remove(i)
                for j in handed:
                    bins[b].remove(j)
                bins[b].append(i)
                bins[giver].extend(handed)
                fill[b] += lengths[i] - back
                fill[giver] -= lengths[i] - back
                takers.remove(b)
                if fill[b] < capacity:
                    takers.add(b, capacity - fill[b], [lengths[i] for i in bins[b]])
                changed = True
            if not bins[giver]:
                spare -= capacity
    return [b for b in bins if b]


class _Takers:
    """Underfull bins by room and by the lengths they can hand back: nothing, one item, or two."""

    def __init__(self, capacity: int) -> None:
        self.bins: dict[tuple[int, int], dict[int, None]] = {}
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # heaps by length handed back, with rooms gone
        self.reach = np.full(capacity + 1, -1)  # that length and the most room any bin has with it
        self.most = np.full(capacity + 1, -1)
        self.held: dict[int, tuple[int, set[int]]] = {}

    def add(self, b: int, room: int, own: list[int]) -> None:
        kinds = sorted(set(own))
        backs = {0, *kinds, *(x + y for k, x in enumerate(kinds) for y in kinds[k + 1 :]), *(2 * x for x, n in Counter(own).items() if n > 1)}
        self.held[b] = (room, backs)
        for back in backs:
            there = self.bins.get((back, room))
            if there is None:
                self.bins[back, room] = {b: None}
                heappush(self.rooms[back], -room)
                if room > self.most[back]:
                    self.most[back] = room
                    self.reach[back] = back + room
            else:
                there[b] = None

    def remove(self, b: int) -> None:
        room, backs = self.held.pop(b)
        for back in backs:
            there = self.bins[back, room]
            del there[b]
            if not there:
                del self.bins[back, room]
                rooms = self.rooms[back]
                while rooms and (back, -rooms[0]) not in self.bins:
                    heappop(rooms)
                self.most[back] = -rooms[0] if rooms else -1
                self.reach[back] = back - rooms[0] if rooms else -1

    def best(self, size: int) -> tuple[int, int] | None:
        """The bin that gains most by an item of ``size``, and the length it hands back; None: no bin gains."""
        fits = self.reach[:size] >= size
        back = int(fits.argmax())
        if not fits[back]:
            return None
        there = self.bins.get((back, size - back)) or self.bins[back, int(self.most[back])]
        return next(iter(there)), back


def _of_length(back: int, items: list[int], lengths: Sequence[int]) -> tuple[int, ...]:
    """No item, the one or the two whose length is ``back``."""
    if not back:
        return ()
    for i in items:
        if lengths[i] == back:
            return (i,)
    return next((i, j) for a, i in enumerate(items) for j in items[a + 1 :] if lengths[i] + lengths[j] == back)


def pack_documents(docs: DataFrame, tokenizer: TokenizerFile, *, capacity: int, end_id: int) -> DataFrame:
    """:func:`cut`, then :func:`pack`, with the pieces settled between them: texts are encoded once."""
    return pack(settle(cut(docs, tokenizer, capacity=capacity, end_id=end_id)), capacity=capacity)
