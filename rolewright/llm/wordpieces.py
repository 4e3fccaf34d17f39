"""Texts cut where no token of a vocabulary can cross, and each distinct cut encoded once.

A byte is a safe start of a chunk when it begins a run of white space after another character: no token of
the two pre-tokenizers used here holds a character and white space after it. It is safe as well between an ASCII letter
and an ASCII punctuation mark, unless the block holds ``<|``, the beginning of special strings.
"""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from rolewright.llm import blocks as B

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 300_000
BATCH_BYTES = 1 << 18
_LETTER = B.byte_set((65, 90), (97, 122))
_MARK = B.byte_set((33, 47), (58, 64), (91, 96), (123, 126))
_open: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, opened once per worker. A bare name is looked up among the public ones."""
    if path not in _open:
        import public_tokenizers
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path if os.path.sep in path else public_tokenizers.path(path))
    return _open[path]


def has_special(data: np.ndarray) -> bool:
    return bool(((data[:-1] == 60) & (data[1:] == 124)).any())


def safe_starts(data: np.ndarray, offsets: np.ndarray, marks: bool) -> np.ndarray:
    """Ascending starts of the chunks that cover the block; every non-empty row begins one."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = B.SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    odd = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1  # white space outside ASCII may end here
    if len(odd):
        cut[odd] = ~((data[np.maximum(odd - 2, 0)] == 0xC2) | np.isin(data[np.maximum(odd - 3, 0)], (0xE1, 0xE2, 0xE3)))
    if marks:
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    rows = offsets[:-1][np.diff(offsets) > 0]
    cut[rows] = True
    return np.flatnonzero(cut)


def split_long(data: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """Starts of pieces of rows, each of about ``limit`` bytes at most where the row has a safe cut."""
    starts = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        starts.append(lo)
        while hi - lo > limit:
            found, reach = np.zeros(0, np.int64), limit
            while not len(found) and lo + reach < hi:
                found = safe_starts(data[lo : lo + reach], np.array([0, reach]), False)[1:]
                reach += limit
            if not len(found):
                break
            lo += int(found[-1])
            starts.append(lo)
    return np.array(starts, np.int64)


def chunk_blocks(batch: pa.RecordBatch, text: int, limit: int = B.BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """(row of the batch, distinct chunks and their index) of each chunk in order, with the chunk starts and bytes."""
    data, offsets = B.text_bytes(batch.column(text))
    starts = split_long(data, offsets, limit)
    owner = np.searchsorted(offsets, starts, "right") - 1 if len(data) else np.zeros(len(starts), np.int64)
    edges = np.append(starts, len(data))
    # of rows without bytes only the last of equal offsets would be found; they have no chunk anyway
    for i, j in B.row_blocks(edges, limit):
        part, at = data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        if not len(part):
            continue
        plain = not has_special(part)
        part = B.lower_ascii(part) if lower and plain else part
        cuts = safe_starts(part, at, plain)
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(part)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part))])
        yield owner[i + np.searchsorted(at, cuts, "right") - 1], chunks.dictionary_encode(), cuts, part
    pa.default_memory_pool().release_unused()


class Remembered:
    """Results per distinct chunk, kept between blocks and tasks of one worker in two generations of about ``bound`` chunks: what is asked
    for again moves to the younger one, and when that is full the older one is dropped."""

    def __init__(self, path: str, result: Callable, bound: int = REMEMBERED):
        self.path, self.result, self.bound, self.young, self.old = path, result, bound, {}, {}

    def __call__(self, distinct: list[bytes]) -> list:
        young, old = self.young, self.old
        missing = []
        for x in distinct:
            if x not in young:
                found = old.get(x)
                if found is None:
                    missing.append(x)
                else:
                    young[x] = found
        for texts in _balanced(missing):
            found = tokenizer(self.path).encode_batch_fast([x.decode("utf-8") for x in texts], add_special_tokens=False)
            young.update(zip(texts, map(self.result, found), strict=True))
        results = [young[x] for x in distinct]
        if len(young) > self.bound:
            self.old, self.young = young, {}
        return results


def _balanced(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Batches of about as many bytes each, so that one batch of long texts does not outweigh the others."""
    batch, size = [], 0
    for x in texts:
        batch.append(x)
        size += len(x) + 16
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


_memories: dict[tuple[str, str], Remembered] = {}


def memory(path: str, kind: str, result: Callable) -> Remembered:
    if (path, kind) not in _memories:
        _memories[path, kind] = Remembered(path, result)
    return _memories[path, kind]
