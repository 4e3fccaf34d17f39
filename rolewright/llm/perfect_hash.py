"""Minimal perfect hash over digests, with a slot for each of them.

Digests are hashed into a bit row somewhat larger than their number. Those that are alone in their place are done and set a bit there; the others go on to the
next, smaller row. The number of a digest is the number of set bits before its own, over all rows: n digests have the numbers 0 .. n - 1. The
function says nothing of other digests, so a slot keeps the digest in full, and a lookup compares all its bytes.
"""
from __future__ import annotations

import numpy as np

from rolewright.llm import blocks as B

DIGEST_BYTES = 32
_GAMMA = 2.0
_LEVELS = 48
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def digest_words(buffer) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.frombuffer(buffer, np.uint64).reshape(-1, DIGEST_BYTES // 8)


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    hashed = B.mix(words[:, 0] ^ B.mix(words[:, 1] + B.mix(words[:, 2] + np.uint64(level)) * _SALT))
    return (hashed % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """``sizes`` bits a row, all rows' bits behind each other; digests that no row could tell apart (``_LEVELS`` rows without success: as good as never) are
    numbered last, by their order in ``left``."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, left: np.ndarray):
        self.sizes, self.bits, self.left = sizes, bits, left
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """Of distinct digests."""
        sizes, rows, rest = [], [], words
        while len(rest) and len(sizes) < _LEVELS:
            size = -(-max(64, int(len(rest) * _GAMMA)) // 64) * 64
            at = _place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            rows.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(rows) if rows else np.zeros(0, np.uint64), rest)

    def number(self, words: np.ndarray) -> np.ndarray:
        """The number of each digest; -1 or any number for those the function was not built for."""
        out = np.full(len(words), -1, np.int64)
        todo = np.arange(len(words))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.base[level] + _place(words[todo], level, size)
            word, rest = np.divmod(at, 64)
            mask = np.uint64(1) << rest.astype(np.uint64)
            hit = (self.bits[word] & mask) != 0
            out[todo[hit]] = (self.before[word] + np.bitwise_count(self.bits[word] & (mask - np.uint64(1))))[hit]
            todo = todo[~hit]
        known = {row.tobytes(): k for k, row in enumerate(self.left)}
        if known:
            first = int(self.before[-1])
            for i in todo.tolist():
                out[i] = first + known[key] if (key := words[i].tobytes()) in known else -1
        return out
