"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix at two unit borders and written in another order.

The bytes of a block of texts get character classes, and a wavelet matrix over them answers everything: the ranks of the classes that end a unit, summed, are
the number of borders up to a place; select (one class) or bisection on the summed ranks (several) finds the border after the k-th unit; and what is no
continuation byte up to a place are its characters. Map-only: one block of about 1 MB at a time, or one longer text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm.wavelet import WaveletMatrix

#: Character classes of UTF-8 bytes, three bits wide.
CONTINUES, LINE_END, BLANK, STOP, SIGN, WORD = range(6)
_LEVELS = 3
#: The classes after which a unit ends; what is left at the end of a text is a unit, too.
UNITS = {"line": (LINE_END,), "word": (LINE_END, BLANK), "sentence": (LINE_END, STOP)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _class_table() -> np.ndarray:
    table = np.full(256, SIGN, np.uint8)
    table[0x80:0xC0] = CONTINUES
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF)):
        table[lo : hi + 1] = WORD
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    table[[ord(c) for c in ".!?"]] = STOP
    table[0x0A] = LINE_END
    return table


_CLASS = _class_table()


def cuts(data: np.ndarray, offsets: np.ndarray, ends: tuple[int, ...], draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the rows of a block: units n, where (byte) prefix and middle end, and the characters of both. The prefix has the smaller of the two
    draws modulo n + 1 as its units, prefix and middle together the larger."""
    codes = _CLASS[data]
    matrix = WaveletMatrix(codes, _LEVELS)
    before = matrix.rank_of(ends, offsets)
    first, closed = before[:-1], np.diff(before)
    full = np.diff(offsets) > 0
    open_end = full.copy()
    open_end[full] = ~np.isin(codes[offsets[1:][full] - 1], ends)
    n = closed + open_end
    units = np.sort(np.stack([d % (n + 1) for d in draws]), 0)
    places = []
    for k in units:
        at = np.where(k == 0, offsets[:-1], offsets[1:])
        inner = (k > 0) & (k <= closed)
        at[inner] = matrix.select_of(ends, (first + k - 1)[inner]) + 1
        places.append(at)
    chars = [p - matrix.rank(CONTINUES, p) for p in (offsets[:-1], *places)]
    return n, *places, chars[1] - chars[0], chars[2] - chars[1]


def _transform(ends: tuple[int, ...], fim_percent: int, spm_percent: int, block_bytes: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 1, block_bytes):
                h1, h2, h3, h4 = (part.column(2 + k).to_numpy() for k in range(4))
                n, one, two, n_prefix, n_middle = cuts(data, offsets, ends, (h1, h2))
                cut = (np.diff(offsets) > 0) & (h3 % 100 < fim_percent)
                spm = h4 % 100 < spm_percent
                outputs, forms = [], []
                for r in range(part.num_rows):
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    if not cut[r] or any(m in raw for m in marks):
                        cut[r] = False
                        outputs.append(raw)
                        forms.append("plain")
                        continue
                    p, m = int(one[r] - offsets[r]), int(two[r] - offsets[r])
                    pieces = [marks[0] + raw[:p], marks[1] + raw[m:], marks[2] + raw[p:m]]
                    if spm[r]:
                        pieces[:2] = pieces[1::-1]
                    outputs.append(b"".join(pieces))
                    forms.append("spm" if spm[r] else "psm")
                text = pa.array(outputs, pa.binary()).cast(pa.string())
                chars = [pa.array(c, mask=~cut) for c in (n_prefix, n_middle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(forms, pa.string()), *chars, text], [c.split()[0] for c in _CUT.split(", ")])

    return transform


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row: its units, ``plain``, ``psm`` or ``spm``, and the transformed text.

    The hash of ``seed:doc_id`` (sha256, four groups of 32 bits) draws both cuts, whether a text is transformed (``fim_percent``) and its order (``spm_percent``), so a row's
    result does not depend on other rows, partitions or retries. psm is prefix, suffix, middle behind their marks; spm is suffix, prefix, middle. A text that is
    empty or null, or that holds one of the marks, stays ``plain`` with null character counts. A null id draws as an empty one. Repeated rows give equal rows; cuts that
    fall together leave an empty middle. Other columns are ignored, whatever their names.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    number = F.col(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(number.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(_transform(UNITS[unit], fim_percent, spm_percent, block_bytes), _CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. Marks cannot overlap and no part of a text holds one, so the first of each in ``output`` is the real one."""
    body = F.substring_index(output, MIDDLE, 1)
    middle = F.substring(output, F.length(body) + len(MIDDLE) + 1, F.length(output))
    first, second = (F.substring_index(body, m, 1) for m in (SUFFIX, PREFIX))
    after_first = F.substring(body, F.length(first) + len(SUFFIX) + 1, F.length(body))
    after_second = F.substring(body, F.length(second) + len(PREFIX) + 1, F.length(body))
    psm = F.concat(F.substring(first, len(PREFIX) + 1, F.length(first)), middle, after_first)
    spm = F.concat(after_second, middle, F.substring(second, len(SUFFIX) + 1, F.length(second)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with hashes for the texts."""
    whole = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))
