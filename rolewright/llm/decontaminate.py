"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of segments. A segment covers whole documents of a few megabytes and lists, for each term, the
ascending positions of its words. Test windows are looked up in every segment: the list of the window's rarest
term there, moved by the term's offset, gives possible starts, and the lists of the other terms, from rare to frequent, thin them out.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm.stage import stage

WINDOW = 10
SEGMENT_BYTES = 1 << 20
TEST_WORDS = 2_000_000
INDEX_SCHEMA = "segment long, doc_ids array<long>, word_offsets array<long>, terms array<long>, term_starts array<int>, positions array<int>"
_HIT_SCHEMA = "segment long, doc int, doc_id long, n_words long, hit array<int>, items array<long>"


def word_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term (hash of the lower-cased word) of every word, and where each row's words begin."""
    low = B.lower_ascii(data)
    starts, ends = B.word_spans(low, offsets, B.ALNUM_OR_WIDE)
    terms = B.Prefix(low).spans(starts, ends).view(np.int64)
    return terms, np.searchsorted(starts, offsets)


def test_terms(tests: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms`` of the test items that have an id and words."""
    rows = tests.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, first = word_terms(*B.text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "terms"])

    return rows.mapInArrow(cut, "item_id long, terms array<long>").where(F.size("terms") > 0)


@dataclass
class Windows:
    """Distinct windows of one block of test items, shorter ones padded with term 0, and the items of each."""

    terms: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray

    @property
    def vocabulary(self) -> np.ndarray:
        inside = np.arange(self.terms.shape[1]) < self.lengths[:, None]
        return np.unique(self.terms[inside])


def windows_of(table: pa.Table, width: int) -> Windows:
    seen: dict[bytes, set[int]] = {}
    for item, terms in zip(table["item_id"].to_pylist(), table["terms"], strict=True):
        terms = terms.values.to_numpy()
        for s in range(max(len(terms) - width, 0) + 1):
            seen.setdefault(terms[s : s + width].tobytes(), set()).add(item)
    keys = sorted(seen)
    lengths = np.array([len(k) // 8 for k in keys], np.int64)
    flat = np.zeros((len(keys), width), np.int64)
    for i, k in enumerate(keys):
        flat[i, : lengths[i]] = np.frombuffer(k, np.int64)
    lists = [sorted(seen[k]) for k in keys]
    return Windows(flat, lengths, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), np.array([i for x in lists for i in x], np.int64))


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: one row per segment. ``terms`` restricts the postings to terms that the tests can ask for; without it
    every word is posted. Each row of ``docs`` is one document of its segment, repeated or null ids included."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = None if terms is None else np.sort(terms)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 1, segment_bytes):
                found, first = word_terms(data, offsets)
                at = np.arange(len(found), dtype=np.int32)
                if wanted is not None:
                    keep = np.zeros(len(found), bool)
                    if len(wanted):
                        keep = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found
                    found, at = found[keep], at[keep]
                order = np.argsort(found, kind="stable")
                distinct, starts = np.unique(found[order], return_index=True)
                lists = [part.column(0).to_pylist(), first.tolist(), distinct, np.append(starts, len(order)).astype(np.int32), at[order]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(lists, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])
                number += 1

    return stage(rows.mapInArrow(segments, INDEX_SCHEMA), "postings")


def near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Starts s such that each list, already moved by its offset, holds a value within ``slop`` of s (with slop 0: s itself).
    Starts come from the first list; the lists are to be given from rare to frequent."""
    starts = lists[0]
    for other in lists[1:]:
        if not len(starts):
            break
        i = np.searchsorted(other, starts - slop)
        starts = starts[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= starts + slop)]
    return starts


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """Words of each document that lie in an occurrence of a window: ``segment, doc, doc_id, n_words, hit, items``, for every document of the index.

    With ``slop`` 0 an occurrence is the exact phrase. With more, each term may stand up to ``slop`` words from its place,
    as seen from the rarest one, and the words that take part are hit.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(1)[r].values
                first, terms, starts, positions = (batch.column(c)[r].values.to_numpy() for c in (2, 3, 4, 5))
                n, hits, items = len(first) - 1, [], []
                for w, found in _occurrences(windows, terms, starts, positions, first, slop):
                    hits.append(found)
                    items.append((np.unique(np.searchsorted(first, found, "right") - 1), windows.items[windows.item_starts[w] : windows.item_starts[w + 1]]))
                hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                bounds = np.searchsorted(hit, first)
                of: list[set[int]] = [set() for _ in range(n)]
                for docs, names in items:
                    for d in docs.tolist():
                        of[d].update(names.tolist())
                inside = hit - first[np.maximum(np.searchsorted(first, hit, "right") - 1, 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[r].as_py())),
                        pa.array(np.arange(n, dtype=np.int32)),
                        ids,
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(inside.astype(np.int32))),
                        pa.array([sorted(x) for x in of], pa.list_(pa.int64())),
                    ],
                    [c.split()[0] for c in _HIT_SCHEMA.split(", ")],
                )

    return index.mapInArrow(look, _HIT_SCHEMA)


def _occurrences(windows: Windows, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, hit positions) of the windows that occur within one document of a segment."""
    if not len(terms) or not len(windows.terms):
        return
    inside = np.arange(windows.terms.shape[1]) < windows.lengths[:, None]
    at = np.minimum(np.searchsorted(terms, windows.terms), len(terms) - 1)
    for w in np.flatnonzero(((terms[at] == windows.terms) | ~inside).all(1)):
        length = int(windows.lengths[w])
        sizes = starts[at[w, :length] + 1] - starts[at[w, :length]]
        lists = [positions[starts[at[w, o]] : starts[at[w, o] + 1]].astype(np.int64) - o for o in np.argsort(sizes, kind="stable")]
        found = near(lists, slop)
        if not len(found):
            continue
        if slop:
            taken = []
            for o in range(length):
                own = positions[starts[at[w, o]] : starts[at[w, o] + 1]].astype(np.int64)
                i = np.searchsorted(own, found + o - slop)
                taken.append(own[i])
            hit = np.stack(taken, 1)
        else:
            hit = found[:, None] + np.arange(length)
        doc = np.searchsorted(first, hit, "right")
        hit = hit[(doc == doc[:, :1]).all(1) & (hit.min(1) >= 0)]
        if len(hit):
            yield int(w), np.unique(hit)


def digest(hits: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from what ``search`` returns."""
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def contamination(
    docs: DataFrame, tests: DataFrame, width: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    test_words: int = TEST_WORDS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """What ``search`` returns for every row of ``docs`` against all windows of ``width`` words of the tests.

    The tests go to the tasks in blocks of about ``test_words`` words, a bound that does not depend on their number; with more than
    one block the hits of a document are merged. Documents without words and null texts have no hits; tests without words or id are left
    out; repeated documents are judged each; repeated items count once; other columns are ignored.
    """
    cut = stage(test_terms(tests, item_col, item_text_col), "test-terms")
    total = cut.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = max(1, -(-total // test_words))
    parts = [windows_of((cut.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else cut).toArrow(), width) for k in range(n)]
    index = build_index(docs, np.unique(np.concatenate([p.vocabulary for p in parts])) if n == 1 else None, id_col, text_col, segment_bytes)
    found = search(index, parts[0], slop)
    if n == 1:
        return found
    for p in parts[1:]:
        found = found.union(search(index, p, slop))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  one entry per block of tests
    return found.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("hit").alias("hit"), flat("items").alias("items"))
