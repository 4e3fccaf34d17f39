"""Vector work on the UTF-8 bytes of an Arrow text column: blocks of rows, words, fingerprints.

Everything here runs inside Spark tasks on one block of a few megabytes at a time, so memory does not depend on
the size of a partition. Null texts are read as empty ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_MULTIPLIER, _INVERSE)):
        if len(_powers[k]) < n:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Final scrambling of 64-bit values, so that every bit depends on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of this length and more are hashed by a second polynomial too, modulo a prime: modulo a power of two alone, any base lets some long sequences collide.
LONG = 256
_PRIME = np.uint64((1 << 31) - 1)
_BASE = 0x2545F491
_prime_powers = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _prime_powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_BASE, pow(_BASE, -1, int(_PRIME)))):
        while len(_prime_powers[k]) < n:  # twice as many a round: the known powers times the next one
            known = _prime_powers[k]
            step = np.uint64(pow(base, len(known), int(_PRIME)))
            _prime_powers[k] = np.concatenate((known, (known.astype(np.uint64) * step % _PRIME).astype(np.uint32)))
    return _prime_powers[0], _prime_powers[1]


class Prefix:
    """Polynomial hashes of any spans of one sequence from one pass of prefix sums; of long spans from two."""

    def __init__(self, values: np.ndarray):
        self.values, self.prime_sums = values, None
        self.up, self.down = _powers_to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        long = np.flatnonzero(ends - starts >= LONG)
        if len(long):
            value[long] ^= mix(self._prime(starts[long], ends[long]))
        return value

    def _prime(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.values)
        up, down = _prime_powers_to(n + 1)
        if self.prime_sums is None:
            terms = (self.values.astype(np.uint64) % _PRIME + np.uint64(1)) * up[:n]
            # each term below 2 ** 32, so the sums of a block stay exact
            self.prime_sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((terms & _PRIME) + (terms >> np.uint64(31)), dtype=np.uint64)))
        return (self.prime_sums[ends] - self.prime_sums[starts]) % _PRIME * down[starts] % _PRIME

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of values[start:end]; equal for equal values wherever they stand."""
        return mix(self.raw(starts, ends))

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all stretches of this length, by start."""
        n = len(self.sums) - length
        if length >= LONG and n > 0:
            return self.spans(np.arange(n), np.arange(n) + length)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; the first offset is 0."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of rows with at most ``limit`` bytes each, or with one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_blocks(batch: pa.RecordBatch, text: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, row offsets) of a batch, block by block."""
    data, offsets = text_bytes(batch.column(text))
    for i, j in row_blocks(offsets, limit):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its JVM


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
ALNUM_OR_WIDE = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of bytes of a set; none crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = mask[edge]
    last[edge - 1] = mask[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the (ascending) row numbers: entries of row r lie in [out[r], out[r + 1])."""
    return np.searchsorted(rows, np.arange(n + 1))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
