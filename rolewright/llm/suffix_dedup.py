"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that begin at anchors (see ``anchors``), in the order of a fingerprint of their first ``gram`` bytes
and then of all that their windows cover. Equal windows have equal anchors, so two occurrences of a string of ``width`` bytes are
neighbours in that order. A new batch gets a suffix array, which is merge-scanned with the levels that exist; levels of equal size then merge, so
n batches leave about log2(n) levels and an entry is rewritten about log2(n) times.

The scan runs over a range partitioning by the whole order, so that a string that fills a third of the corpus spreads over many tasks; only the first
and last entry of each task are compared on the driver. Entries whose whole context repeats are settled there. The others, at
the borders of repeats, are compared window by window among those that share a longer core.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewright.llm import anchors as A
from rolewright.llm import blocks as B
from rolewright.llm.stage import identified, stage

WIDTH = 200
GRAM = 64
GROUP_ROWS = 20_000
_ENTRY = "key long, context long, doc long, start int, shape int"
_SCANNED = _ENTRY + ", whole boolean, mixed boolean, part int, edge int"


def suffix_array(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Entries of the anchors of ``identified`` rows. ``shape`` is the anchor's place times the width plus the number of windows."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for first, part, at, base in A.long_row_blocks(data, offsets, width, block_bytes):
                a = A.anchors(part, at, width, gram)
                shape = (a.place * width + a.count).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.key, a.context, ids[first + a.row], (a.start + base).astype(np.int32), shape)], ["key", "context", "doc", "start", "shape"])

    return rows.select("doc", "text").mapInArrow(entries, _ENTRY)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order: those with a neighbour of the same key and context (whole) or of the same key and another context (mixed; each
    context of a key that has several gives one or two), and the first and last of the task (edge 1, 2, or 3 for both)."""
    part, held, seen_any = TaskContext.get().partitionId(), None, False
    names = [c.split()[0] for c in _SCANNED.split(", ")]

    def flags(table: pa.Table, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        key, context = table["key"].to_numpy(), table["context"].to_numpy()
        same = key[1:] == key[:-1]
        equal = same & (context[1:] == context[:-1])
        whole, mixed = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for out, link in ((whole, equal), (mixed, same & ~equal)):
            out[1:] |= link
            out[:-1] |= link
        if before is not None:
            whole[0] |= before[0]
            mixed[0] |= before[1]
        return whole, mixed

    def out(table: pa.Table, whole: np.ndarray, mixed: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        full = table
        for name, values in (("whole", pa.array(whole)), ("mixed", pa.array(mixed)), ("part", pa.array(np.full(n, part, np.int32))), ("edge", pa.array(edge))):
            full = full.append_column(name, values)
        yield from full.select(names).filter(pa.array(whole | mixed | (edge > 0))).combine_chunks().to_batches()

    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        whole, mixed = flags(table, carried)
        edge = np.zeros(table.num_rows, np.int32)
        if not seen_any:
            edge[0] = 1
        if table.num_rows > 1:
            yield from out(table.slice(0, table.num_rows - 1), whole[:-1], mixed[:-1], edge[:-1])
            seen_any = True
        held, carried = table.slice(table.num_rows - 1), (bool(whole[-1]), bool(mixed[-1]))
    if held is not None:
        yield from out(held, np.array([carried[0]]), np.array([carried[1]]), np.array([2 if seen_any else 3], np.int32))


def merge_scan(*levels: DataFrame) -> DataFrame:
    """``key, context, doc, start, shape, whole, mixed`` of the entries of these sorted tables that share key and context with another one (whole),
    and of at least one entry of each context among those that share their key only (mixed)."""
    entries = levels[0]
    for other in levels[1:]:
        entries = entries.unionByName(other)
    ordered = entries.repartitionByRange("key", "context", "doc", "start").sortWithinPartitions("key", "context")
    found = stage(ordered.mapInArrow(_scan, _SCANNED), "merge-scan")
    edges = sorted(found.where("edge > 0").collect(), key=lambda r: (r.part, r.edge))  # two rows a task
    joined: dict[tuple, list] = {}
    for a, b in zip(edges, edges[1:], strict=False):
        if a.part != b.part and a.key == b.key:
            for r in (a, b):
                old = joined.setdefault((r.part, r.edge), [r, r.whole, r.mixed])
                old[1] = old[1] or a.context == b.context
                old[2] = old[2] or a.context != b.context
    columns = ["key", "context", "doc", "start", "shape", "whole", "mixed"]
    inner = found.where("whole or mixed").where(~_is_edge(joined)).select(columns)
    if not joined:
        return inner
    rows = [(r.key, r.context, r.doc, r.start, r.shape, w, m) for r, w, m in joined.values()]
    return inner.unionByName(found.sparkSession.createDataFrame(rows, _ENTRY + ", whole boolean, mixed boolean"))


def _is_edge(which: dict[tuple, list]):
    hit = F.lit(False)
    for part, edge in which:
        hit = hit | ((F.col("part") == part) & (F.col("edge") == edge))
    return hit


@dataclass
class SuffixIndex:
    """Levels of suffix arrays: level i, where there is one, holds 2 ** i batches."""

    width: int = WIDTH
    gram: int = GRAM
    block_bytes: int = B.BLOCK_BYTES
    levels: list[DataFrame | None] = field(default_factory=list)

    def insert(self, rows: DataFrame) -> None:
        """Give a batch of ``identified`` rows a suffix array and merge levels of equal size, smallest first."""
        merged, at = self._array(rows), 0
        while at < len(self.levels) and self.levels[at] is not None:
            merged, self.levels[at], at = merged.unionByName(self.levels[at]), None, at + 1
        if at:
            merged = stage(merged.repartitionByRange("key", "context").sortWithinPartitions("key", "context"), "suffix-level")
        self.levels += [None] * (at + 1 - len(self.levels))
        self.levels[at] = merged

    def matches(self, rows: DataFrame) -> DataFrame:
        """Merge-scan the suffix array of a batch, which isn't inserted, with all levels: what repeats in the batch, in the levels or across."""
        return merge_scan(self._array(rows), *[x for x in self.levels if x is not None])

    def _array(self, rows: DataFrame) -> DataFrame:
        return stage(suffix_array(rows, self.width, self.gram, self.block_bytes), "suffixes")


def _cores(width: int, gram: int):
    """Half stretches of windows of the listed entries, with the hash of what all windows of that half of an anchor share."""
    half = (width - gram + 1) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 1):
                lists = part.column(2)
                at = lists.offsets.to_numpy().astype(np.int64)
                values = lists.flatten()
                start, shape = (values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                first = offsets[row] + start
                place, count = first + shape // width, shape % width
                prefix = B.Prefix(data)
                middle = place - half + 1  # windows that start here or later form the right half
                ids = part.column(0).to_numpy()
                for lo, hi, a, b in (
                    (np.maximum(first, middle), first + count, place, middle + width),
                    (first, np.minimum(first + count, middle), middle - 1, place + gram),
                ):
                    keep = np.flatnonzero(hi > lo)
                    lo, n = lo[keep], (hi - lo)[keep]
                    core = prefix.spans(a[keep], b[keep]).view(np.int64)
                    sizes = n + width - 1
                    content = data[B.spread(lo, sizes)]
                    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(bounds), pa.py_buffer(content)])
                    yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(ids[row[keep]]), pa.array((lo - offsets[row[keep]]).astype(np.int32)), binary], ["core", "doc", "start", "content"])

    return cut


def _compare(width: int, group_rows: int):
    """Windows that occur more than once among the entries of a core: stretches (doc, start, stop), or, for cores with very many
    entries, every window with its hash, to be counted outside."""
    names = ["doc", "start", "stop", "window"]

    def windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content = table["content"].combine_chunks() if table["content"].num_chunks != 1 else table["content"].chunk(0)
        _, at, data = content.buffers()
        at = np.frombuffer(at, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
        starts = A.window_starts(at, width)
        row = B.rows_of(starts, at)
        return B.Prefix(data).spans(starts, starts + width), row, table["start"].to_numpy().astype(np.int64)[row] + starts - at[row]

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        core = table["core"].to_numpy()
        shared = np.zeros(len(core), bool)
        shared[1:] |= core[1:] == core[:-1]
        shared[:-1] |= core[1:] == core[:-1]
        table = table.filter(pa.array(shared))
        if not table.num_rows:
            return
        hashes, row, place = windows(table)
        _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(counts[back] > 1)
        if not len(hit):
            return
        new = np.concatenate(([True], (row[hit[1:]] != row[hit[:-1]]) | (place[hit[1:]] != place[hit[:-1]] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        doc = table["doc"].to_numpy()[row[hit[first]]]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place[hit[first]].astype(np.int32)), pa.array((place[hit[last]] + width).astype(np.int32)), pa.nulls(len(first), pa.int64())], names)

    def unsettled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, 2000):
            part = table.slice(at, 2000)
            hashes, row, place = windows(part)
            yield pa.RecordBatch.from_arrays([pa.array(part["doc"].to_numpy()[row]), pa.array(place.astype(np.int32)), pa.array((place + width).astype(np.int32)), pa.array(hashes.view(np.int64))], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # entries of the last core so far; the core whose entries are passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            core = table["core"].to_numpy()
            tail = int(np.searchsorted(core, core[-1], "left"))
            if large is not None:
                n = int(np.searchsorted(core, large, "right"))
                yield from unsettled(table.slice(0, n))
                table, core, tail = table.slice(n), core[n:], max(tail - n, 0)
                if not table.num_rows:
                    held = None
                    continue
                large = None
            yield from settled(table.slice(0, tail))
            held = table.slice(tail)
            if held.num_rows > group_rows:
                large = int(core[-1])
                yield from unsettled(held)
                held = None
        if held is not None:
            yield from settled(held)

    return compare


def repeated_stretches(rows: DataFrame, found: DataFrame, width: int = WIDTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc, start, stop`` of stretches that windows with a second occurrence cover, from what the merge-scans found."""
    whole = found.where("whole").select("doc", "start", (F.col("start") + F.col("shape") % width + (width - 1)).cast("int").alias("stop"))
    border = found.where("mixed").groupBy("doc").agg(F.collect_list(F.struct("start", "shape")).alias("entries"))
    cores = rows.join(border, "doc").select("doc", "text", "entries").mapInArrow(_cores(width, gram), "core long, doc long, start int, content binary")
    compared = stage(cores.repartition("core").sortWithinPartitions("core").mapInArrow(_compare(width, group_rows), "doc long, start int, stop int, window long"), "borders")
    open_ = compared.where(F.col("window").isNotNull())
    again = open_.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    counted = open_.join(again, "window").select("doc", "start", "stop")
    return whole.unionByName(compared.where(F.col("window").isNull()).select("doc", "start", "stop")).unionByName(counted)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of a union; stretches that touch count as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_bytes(batch.column(1))
        marks = batch.column(2)
        removed, spans, kept = [], [], []
        for r in range(batch.num_rows):
            text = data[offsets[r] : offsets[r + 1]]
            values = marks[r].values
            if values is None or not len(values):
                removed.append(0)
                spans.append(0)
                kept.append(text.tobytes())
                continue
            lo, hi = merged(values.field(0).to_numpy(), values.field(1).to_numpy())
            removed.append(int((hi - lo).sum()))
            spans.append(len(lo))
            edge = [0, *np.stack((lo, hi), 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row: each byte goes that lies in a string of ``width`` bytes that starts
    at another place as well, in the same document or another one, in the text as it was given.

    The documents come in ``batches`` by a hash of id and text; all but the last are inserted and its scan with the levels finds every match.
    ``kept`` is binary: a cut may fall inside a character. Null and empty texts
    have 0 bytes and keep nothing. Rows that agree in id and text are copies of each other, so long ones are removed whole. Texts shorter than
    ``width`` stay. Other columns are ignored, whatever their names.
    """
    rows = identified(docs, id_col, text_col)
    index = SuffixIndex(width, gram, block_bytes)
    parts = [rows.where(F.pmod("doc", F.lit(batches)) == k) for k in range(batches)] if batches > 1 else [rows]
    for part in parts[:-1]:
        index.insert(part)
    stretches = repeated_stretches(rows, index.matches(parts[-1]), width, gram, group_rows)
    marks = stretches.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    joined = rows.join(marks, "doc", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
