"""Line dedup by winnowing over line hashes.

A document is a sequence of line hashes. Grams of ``gram`` consecutive lines are hashed and the least of every ``run - gram + 1`` of them is a
fingerprint (see ``anchors``), so any run of ``run`` lines that stands at two places holds the same fingerprint at the same place in both: a guarantee.
Positions are joined on fingerprints that occur more than once. A match is extended both ways: around a fingerprint every window of ``run`` lines that it
stands for is compared, and a longer match is a chain of such windows. Of equal windows the first by document and line stays.

Windows of fewer than ``run`` lines that hold ``words`` words or more, if that is asked for, are their own fingerprints: each of them is stored, joined and compared.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolewright.llm import anchors as A
from rolewright.llm import blocks as B
from rolewright.llm.stage import discard, identified, stage

RUN = 3
GRAM = 2
#: Words that make a repeated passage of fewer lines than RUN a run as well.
WORDS = 50
_POSITIONS = "print long, doc_id long, doc long, line int, length int, windows array<long>"


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of all lines of a block, where each row's lines begin, and the words of every line. A line ends at ``\\n`` or with the
    text; nothing follows a last line end. White space around a line does not count, and A-Z is lower-cased."""
    low = B.lower_ascii(data)
    ends = np.flatnonzero(low == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.unique(np.concatenate((offsets[full], ends[~np.isin(ends + 1, offsets)] + 1)))
    first = np.searchsorted(starts, offsets)
    words, stops = B.word_spans(low, offsets, B.NOT_SPACE)
    lo, hi = np.searchsorted(words, starts), np.searchsorted(words, np.append(starts[1:], len(low)))
    has = hi > lo
    begin, end = starts.copy(), starts.copy()
    begin[has], end[has] = words[lo[has]], stops[hi[has] - 1]
    return starts, B.Prefix(low).spans(begin, end), first, hi - lo


def _positions(run: int, gram: int, words: int | None, block_bytes: int):
    names = [c.split()[0] for c in _POSITIONS.split(", ")]

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 2, block_bytes):
                _, lines, at, n_words = line_hashes(data, offsets)

                def rows(row, key, start, length, count, windows, part=part) -> pa.RecordBatch:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(windows.view(np.int64)))
                    of, sizes = pa.array(row), pa.array(np.full(len(row), length, np.int32))
                    return pa.RecordBatch.from_arrays([pa.array(key), part.column(1).take(of), part.column(0).take(of), pa.array(start.astype(np.int32)), sizes, lists], names)

                a = A.anchors(lines, at, run, gram)
                if len(a.row):
                    places = B.spread(at[a.row] + a.start, a.count)
                    yield rows(a.row, a.key, a.start, run, a.count, B.Prefix(lines).spans(places, places + run))
                total = np.concatenate(([0], np.cumsum(n_words)))
                for length in range(1, run) if words is not None else ():
                    begin = A.window_starts(at, length)
                    begin = begin[total[begin + length] - total[begin] >= words]
                    if len(begin):
                        row = B.rows_of(begin, at)
                        key = B.mix(B.Prefix(lines).spans(begin, begin + length) + np.uint64(length))
                        yield rows(row, key.view(np.int64), begin - at[row], length, np.ones(len(begin), np.int64), key)

    return positions


def _cut(run: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            removed, texts, counts = [], [], []
            for r in range(batch.num_rows):
                text = data[offsets[r] : offsets[r + 1]]
                raw = text.tobytes()
                lines = raw.removesuffix(b"\n").split(b"\n") if raw else []
                gone = np.zeros(len(lines), bool)
                if batch.column(2)[r].is_valid:
                    at, more = np.divmod(batch.column(2)[r].values.to_numpy().astype(np.int64), run)
                    gone[np.minimum(B.spread(at, more + 1), len(lines) - 1)] = True
                kept = [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
                texts.append((b"\n".join(kept) + raw[-1:] * (bool(kept) and raw.endswith(b"\n"))).decode())
                removed.append(np.flatnonzero(gone).tolist())
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.int32())), *batch.columns[4:]],
                ["doc", "doc_id", "kept_text", "n_lines", "removed", *batch.schema.names[4:]],
            )

    return cut


def remove_repeated_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, carry: tuple[str, ...] = (), words: int | None = None) -> DataFrame:
    """``doc, doc_id, kept_text, n_lines, removed`` for every row; ``removed`` lists the removed lines, counted from 0.

    A line goes if it lies in a run of at least ``run`` lines that stands earlier as well: in a document with a smaller id, or earlier in the same one. With ``words`` a run
    of fewer lines counts too if it holds that many words (between white space), so a long passage on one line and a copy of a document of one or two lines go. Lines are compared
    without white space around them and with A-Z lower-cased; blank lines count as lines, but a run of blank lines only is never removed. The remaining lines are joined
    by line ends as they were. Null and empty texts have no lines and an empty ``kept_text``. Null ids come before all others; of documents with one id
    the order is that of a hash of the text. Rows that agree in id and text count as one document, at one place: they lose the same lines.
    Other columns are ignored, whatever their names, unless ``carry`` lists them: these travel along as the fields of a struct ``carried``.
    """
    rows = identified(docs, id_col, text_col)
    found = stage(rows.mapInArrow(_positions(run, gram, words, block_bytes), _POSITIONS), "line-prints")
    # a fingerprint that one line window of one document holds alone has nothing to be joined with
    often = found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    joined = found.join(often, "print").select("doc_id", "doc", F.posexplode("windows").alias("k", "window"), "line", "length")
    windows = stage(joined.select("window", "doc_id", "doc", (F.col("line") + F.col("k")).alias("line"), "length"), "line-windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "doc", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first.where(F.col("window") != _blank(run)), "window").where(F.struct("doc_id", "doc", "line") > F.col("first"))
    gone = stage(later.groupBy("doc").agg(F.collect_set(F.col("line") * run + F.col("length") - 1).alias("starts")), "repeated-lines")
    discard(found, windows)
    # the joins that carry texts are merge joins at every size: one plan, whose cost grows as the texts do
    kinds = (("doc", T.LongType()), ("doc_id", T.LongType()), ("kept_text", T.StringType()), ("n_lines", T.LongType()), ("removed", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(*k) for k in kinds])
    if not carry:
        return rows.join(gone.hint("merge"), "doc", "left").select("doc_id", "text", "starts", "doc").mapInArrow(_cut(run), schema)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*carry).alias("carried"))
    cut = whole.join(gone.hint("merge"), "doc", "left").select("doc_id", "text", "starts", "doc", "carried")
    return cut.mapInArrow(_cut(run), T.StructType([*schema.fields, T.StructField("carried", whole.schema["carried"].dataType)]))


def _blank(run: int) -> int:
    """Hash of a window of blank lines."""
    blank = B.Prefix(np.zeros(0, np.uint8)).spans(np.zeros(1, np.int64), np.zeros(1, np.int64))
    return int(B.Prefix(np.repeat(blank, run)).spans(np.array([0]), np.array([run])).view(np.int64)[0])
