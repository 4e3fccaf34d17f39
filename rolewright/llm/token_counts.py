"""Token counts: batches balanced by bytes are encoded inside Arrow functions that return lengths only."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm import wordpieces as WP


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, as encoding the whole text without added tokens gives them.

    ``vocabulary``: path of a tokenizer file, or the name of a public one. Special strings inside a text count as
    the library's default has it. One scan without a shuffle; a block holds about ``block_bytes``.
    Null and empty texts have 0 bytes and 0 tokens. Long texts are cut at white space, across which no token
    reaches. Repeated rows give repeated rows; a null id stays null; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = WP.memory(vocabulary, "lengths", len)
        for batch in batches:
            _, offsets = B.text_bytes(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for row, chunks, _, _ in WP.chunk_blocks(batch, 1, block_bytes):
                each = np.array(count(chunks.dictionary.to_pylist()), np.int64)
                tokens += np.bincount(row, each[chunks.indices.to_numpy()], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
