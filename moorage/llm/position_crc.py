"""CRC-32 of many spans of one byte array at once.

CRC-32 is linear but for a constant: the sum of a message is that of as many zero bytes (its length constant), xored with
one contribution for each byte that depends on the byte and its distance from the end alone. Contributions for
the distances below ``BLOCK`` are in a table; a span's are xored by ``bitwise_xor.reduceat``. A longer span is cut into
blocks from its end; its blocks' sums are folded in pairs, the front one moved on by the bytes behind it, until one is left.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: Bytes of a block, a power of two.
BLOCK = 64
_FULL = np.uint32(0xFFFFFFFF)


@cache
def _contributions() -> np.ndarray:
    """For each distance from the end, each byte's contribution."""
    return np.array([zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for d in range(BLOCK) for b in range(256)], np.uint32)


@cache
def _moved_on(log_bytes: int) -> np.ndarray:
    """(4, 256): what each byte of a sum becomes when 2**log_bytes zero bytes follow."""
    if log_bytes == 0:
        # One zero byte: the low byte goes through the table of single bytes, the others move down.
        single = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        return np.stack([single, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])
    half = _moved_on(log_bytes - 1)
    return _apply(half, half)


def _apply(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = table[0][sums & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][sums >> np.uint32(8 * k) & np.uint32(255)]
    return out


@cache
def _short_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of as many zero bytes."""
    out = _short_constants()[np.minimum(lengths, BLOCK)]
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        register, left, log = np.full(len(long), _FULL), lengths[long].copy(), 0
        while left.any():
            odd = left & 1 == 1
            register[odd] = _apply(_moved_on(log), register[odd])
            left, log = left >> 1, log + 1
        out[long] = register ^ _FULL
    return out


def crc32_of_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``flat[start:end]`` for each span. Spans are not empty, in order, and do not overlap; bytes between them don't count."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    blocks = (lengths + BLOCK - 1) // BLOCK
    if blocks.max() == 1:
        return _linear(flat, starts, ends) ^ length_constants(lengths)
    behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(blocks.sum())  # blocks behind each in its span
    span = np.repeat(np.arange(len(starts)), blocks)
    block_ends = ends[span] - behind * BLOCK
    sums = _linear(flat, np.maximum(block_ends - BLOCK, starts[span]), block_ends)
    log = BLOCK.bit_length() - 1
    while len(sums) > len(starts):
        ahead = behind & 1 == 1
        sums[ahead] = _apply(_moved_on(log), sums[ahead])
        behind >>= 1
        first = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (behind[1:] != behind[:-1])))
        sums, span, behind, log = np.bitwise_xor.reduceat(sums, first), span[first], behind[first], log + 1
    return sums ^ length_constants(lengths)


def _linear(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Xor of the contributions of each span's bytes; spans are at most a block long."""
    begin, stop = int(starts[0]), int(ends[-1])
    place = np.repeat((ends - 1 - begin).astype(np.int32), np.diff(starts, append=stop))
    place -= np.arange(stop - begin, dtype=np.int32)
    np.maximum(place, 0, out=place)  # between spans: left out below
    place <<= 8
    place |= flat[begin:stop]
    found = np.append(_contributions()[place], np.uint32(0))
    edges = np.stack([starts - begin, ends - begin], axis=1).ravel()
    return np.bitwise_xor.reduceat(found, edges)[::2]
