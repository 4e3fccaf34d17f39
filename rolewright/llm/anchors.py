"""Anchors: the stretches of consecutive windows of a sequence that share their window minimum.

Every window of ``width`` values holds ``width - gram + 1`` grams; its anchor is the gram with the least hash, the first of equals. Equal
windows have equal anchors at equal places, so whatever repeats over a whole window can be found among the entries of one
anchor hash, and only about two of ``width - gram + 2`` positions are anchors.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rolewright.llm import blocks as B

_PLACE_BITS = 26


@dataclass
class Anchors:
    """For each stretch of windows: its row, first window (in the row), number of windows, the anchor's place after the first window's start, hash of
    the anchor gram, and hash of all that the windows cover together with that place."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    place: np.ndarray
    key: np.ndarray
    context: np.ndarray


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that lie within one row."""
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    return B.spread(offsets[:-1], lengths)


def anchors(values: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> Anchors:
    """Anchors of a block of rows; no window crosses a row. A block holds less than 2 ** 26 values."""
    none = np.zeros(0, np.int64)
    if len(values) < width:
        return Anchors(none, none, none, none, none, none)
    prefix = B.Prefix(values)
    grams = prefix.runs(gram)
    # hash above, place below: the minimum names the place of the first least gram
    low = (grams & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    starts = window_starts(offsets, width)
    if not len(starts):
        return Anchors(none, none, none, none, none, none)
    at = at[starts]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, place = starts[first], at[first]
    context = B.mix(prefix.raw(begin, begin + count - 1 + width) ^ B.mix((place - begin).astype(np.uint64)))
    row = B.rows_of(begin, offsets)
    return Anchors(row, begin - offsets[row], count, place - begin, grams[place].view(np.int64), context.view(np.int64))


def long_row_blocks(data: np.ndarray, offsets: np.ndarray, width: int, limit: int) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its row): blocks of whole rows, and of rows over the limit stretches that
    overlap by ``width - 1``, so that each window lies in exactly one block."""
    found = []
    for i, j in B.row_blocks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j - i > 1 or hi - lo <= 2 * limit:
            found.append((i, data[lo:hi], offsets[i : j + 1] - lo, 0))
            continue
        for at in range(lo, max(hi - width + 1, lo + 1), limit):
            part = data[at : min(at + limit + width - 1, hi)]
            found.append((i, part, np.array([0, len(part)]), at - lo))
    return found
