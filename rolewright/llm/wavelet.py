"""Wavelet matrix over a sequence of small codes: how often a code stands before a place, and where its k-th occurrence stands.

Level by level, from the highest bit of the codes on, the bits are kept as a plain bit row with counts per 64 of them, and the codes are
dealt into those with bit 0 and those with bit 1, in order. All queries take arrays, so that a block of documents is asked at once. Three
levels of bits and their counts are about 0.6 bytes a code.
"""
from __future__ import annotations

import numpy as np

_WORD = 64


class _Bits:
    """A row of bits with rank and select."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // _WORD + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, bit: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are ``bit``."""
        word, rest = np.divmod(at, _WORD)
        mask = (np.uint64(1) << rest.astype(np.uint64)) - np.uint64(1)
        ones = self.before[word] + np.bitwise_count(self.words[word] & mask)
        return ones if bit else at - ones

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th ``bit``, counted from 0: the last place with no more than k before it, by bisection on the counts and then on ranks."""
        counts = self.before if bit else np.arange(len(self.before), dtype=np.int64) * _WORD - self.before
        lo = (np.searchsorted(counts, k, "right") - 1) * _WORD
        step = _WORD // 2
        while step:
            ahead = np.minimum(lo + step, self.n)
            lo = np.where(self.rank(bit, ahead) <= k, ahead, lo)
            step //= 2
        return lo


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, levels: int):
        self.n, self.levels = len(codes), levels
        self.rows: list[_Bits] = []
        self.zeros: list[int] = []
        for level in range(levels - 1, -1, -1):
            bits = (codes >> level & 1).astype(bool)
            self.rows.append(_Bits(bits))
            low = codes[~bits]
            self.zeros.append(len(low))
            codes = np.concatenate((low, codes[bits]))

    def _descend(self, code: int, at: np.ndarray) -> np.ndarray:
        for k, row in enumerate(self.rows):
            bit = code >> (self.levels - 1 - k) & 1
            at = row.rank(bit, at) + (self.zeros[k] if bit else 0)
        return at

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place."""
        return self._descend(code, at) - self._descend(code, np.zeros(1, np.int64))

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th ``code`` of the sequence, counted from 0; each k has to be less than its number."""
        at = k + self._descend(code, np.zeros(1, np.int64))
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self.rows[level].select(bit, at - (self.zeros[level] if bit else 0))
        return at

    def rank_of(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How often any of ``codes`` stands before each place."""
        return sum((self.rank(c, at) for c in codes), np.zeros(len(at), np.int64))

    def select_of(self, codes: tuple[int, ...], k: np.ndarray) -> np.ndarray:
        """Place of the k-th code that is any of ``codes``: ``select`` for a single one, else bisection on the summed ranks."""
        if len(codes) == 1:
            return self.select(codes[0], k)
        lo, step = np.zeros(len(k), np.int64), 1 << max(self.n, 1).bit_length()
        while step:
            ahead = np.minimum(lo + step, self.n)
            lo = np.where(self.rank_of(codes, ahead) <= k, ahead, lo)
            step //= 2
        return lo
