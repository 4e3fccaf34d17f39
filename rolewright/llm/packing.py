"""Packing: sequences cut at document or sentence boundaries by dynamic programming with a monotone queue.

The cost of a layout is its padding plus a penalty for each cut inside a document: small at the end of a sentence,
larger inside one. With the token position p and the penalty c of each possible cut,

    f(j) = c(j) + width - p(j) + min over cuts i with p(j) - p(i) <= width of (f(i) + p(i)),

and the minimum over that sliding stretch of cuts comes from a monotone queue, so each cut is handled once.
"""
from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm import wordpieces as WP

WIDTH = 4096
SENTENCE_PENALTY = 24
HARD_PENALTY = 160
SPACING = 12
STRETCH_TOKENS = 1 << 20
_SENTENCE_END = B.byte_set((33, 33), (46, 46), (63, 63))
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(positions: list[int], penalties: list[int], width: int = WIDTH) -> list[int]:
    """Indices of the cuts of the cheapest layout, the first and the last position included.

    ``positions`` ascend from 0 with no step over ``width``; ``penalties[i]`` is what a cut at i costs. Of equal layouts
    the one whose last sequence is longest wins, and so on backwards.
    """
    n = len(positions)
    total, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + p, index), ascending in f + p
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0][1]] < p - width:
            queue.popleft()
        value, i = queue[0]
        cost = penalties[j] + width - p + value
        total[j], back[j] = cost, i
        value = cost + p
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    path, j = [n - 1], n - 1
    while j:
        j = back[j]
        path.append(j)
    return path[::-1]


def powers_of_two(length: int) -> list[int]:
    """Lengths that sum to ``length`` and of which each is a power of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class _Stream:
    """Documents of one task in their order, packed stretch by stretch."""

    def __init__(self, width: int, spacing: int, sentence: int, hard: int, first_id: int):
        self.width, self.spacing, self.sentence, self.hard, self.next_id = width, spacing, sentence, hard, first_id
        self.docs: list[list] = []  # [doc_id, ids, tokens of the document already placed]
        self.cuts: list[np.ndarray] = []  # candidate cuts by document, relative to its first id
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.cuts.append(ends)
        self.held += len(ids)
        if self.held >= STRETCH_TOKENS:
            yield from self.place(False)

    def candidates(self) -> tuple[list[int], list[int]]:
        at, positions, penalties = 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for (_, ids, done), ends in zip(self.docs, self.cuts, strict=True):
            inner = ends[ends > done] - done
            left = len(ids) - done
            if len(inner):
                block = inner // self.spacing  # at most one cut in each stretch of `spacing` tokens
                inner = inner[np.append(block[1:] != block[:-1], True)]
                inner = inner[inner < left]
            marks = np.concatenate(([0], inner, [left]))
            gaps = np.diff(marks)
            if gaps.max(initial=0) > self.width // 8:
                step = self.width // 16
                extra = np.concatenate([np.arange(a + step, b, step) for a, b in zip(marks[:-1], marks[1:], strict=True) if b - a > self.width // 8])
                inner, which = np.concatenate((inner, extra)), np.concatenate((np.full(len(inner), self.sentence), np.full(len(extra), self.hard)))
                order = np.argsort(inner, kind="stable")
                inner, which = inner[order], which[order]
            else:
                which = np.full(len(inner), self.sentence)
            positions += [at + inner, np.array([at + left])]
            penalties += [which, np.zeros(1, np.int64)]
            at += left
        return np.concatenate(positions).tolist(), np.concatenate(penalties).tolist()

    def place(self, final: bool) -> Iterator[tuple]:
        positions, penalties = self.candidates()
        if len(positions) < 2:
            return
        lengths = np.diff([positions[i] for i in best_cuts(positions, penalties, self.width)]).tolist()
        if final:
            lengths = lengths[:-1] + (powers_of_two(lengths[-1]) if lengths[-1] < self.width else lengths[-1:])
        else:
            lengths = lengths[:-2]  # the end of a stretch is no end of the text: its last sequences are packed again
        d = 0
        for length in lengths:
            filled = 0
            while filled < length:
                doc = self.docs[d]
                doc_id, ids, done = doc
                take = min(length - filled, len(ids) - done)
                piece = ids[done : done + take]
                yield doc_id, done, take, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.next_id, filled
                doc[2] += take
                filled += take
                if doc[2] == len(ids):
                    d += 1
            self.next_id += 1
        self.docs, self.cuts = self.docs[d:], self.cuts[d:]
        self.held = sum(len(ids) - done for _, ids, done in self.docs)


def _encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int, block_bytes: int) -> Iterator[tuple]:
    """(row, ids, candidate cuts) of each row in order."""
    known = WP.memory(vocabulary, "ids", lambda e: np.array(e.ids, "<u4").tobytes())
    ready, parts, ends, held = 0, [], [], 0

    def finish(upto: int) -> Iterator[tuple]:
        nonlocal ready, parts, ends, held
        while ready < upto:
            ids = np.concatenate([*parts, [end_id]]).astype(np.uint32)
            yield ready, ids, np.concatenate(ends) if ends else np.zeros(0, np.int64)
            ready, parts, ends, held = ready + 1, [], [], 0

    for row, chunks, cuts, data in WP.chunk_blocks(batch, 1, block_bytes, lower=True):
        found = known(chunks.dictionary.to_pylist())
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(each) - each
        index = chunks.indices.to_numpy()
        sizes = each[index]
        ids = flat[B.spread(first[index], sizes)]
        after = np.cumsum(sizes)
        stops = np.append(cuts[1:], len(data))
        sentence = _SENTENCE_END[data[stops - 1]]
        sentence[:-1] |= data[cuts[1:]] == 10
        bounds = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
        lo = 0
        for hi in bounds.tolist():
            yield from finish(int(row[lo]))
            base = after[lo - 1] if lo else 0
            parts.append(ids[base : after[hi - 1]])
            inner = after[lo:hi][sentence[lo:hi]] - base
            ends.append(inner + held)
            held += int(after[hi - 1] - base)
            lo = hi
    yield from finish(batch.num_rows)


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    width: int = WIDTH,
    spacing: int = SPACING,
    sentence_penalty: int = SENTENCE_PENALTY,
    hard_penalty: int = HARD_PENALTY,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of every document.

    A document is its token ids followed by ``end_id``. Documents keep the order in which they are stored; each task packs what it
    reads, so there is no shuffle, and a task that runs again gives the same pieces and ids. Sequences hold at most ``width`` ids; cuts lie at
    documents' ends, at sentence ends (no two of them within the same ``spacing`` ids of a document) or, where a sentence is
    longer than an eighth of the width, inside it. What is left at the end of a task is cut into lengths that are powers of two.
    Null, empty and blank texts are one id long. Repeated rows are packed as often as they occur. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(width, spacing, sentence_penalty, hard_penalty, TaskContext.get().partitionId() << 40)

        def batched(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)], names)

        for batch in batches:
            found: list[tuple] = []
            ids_of = batch.column(0).to_pylist()
            for row, ids, ends in _encoded(batch, vocabulary, end_id, block_bytes):
                found.extend(stream.add(ids_of[row], ids, ends))
            if found:
                yield batched(found)
        if found := list(stream.place(True)):
            yield batched(found)

    return rows.mapInArrow(pieces, SCHEMA)
