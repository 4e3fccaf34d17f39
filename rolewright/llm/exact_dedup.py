"""Exact dedup against a history of distinct digests behind a minimal perfect hash.

The history is a table of shards, dealt by digest. A shard holds a minimal perfect hash of its digests and, in the slot of each, the digest in full, the locator of
the document that stays (its id and its place) and how many documents had the text. A batch is reduced to its distinct digests, map-side first, so a text that a third
of all rows share is one probe; its probes meet the shards by shard number, and one lookup of 32 compared bytes tells members of the history from
nonmembers, which are groups of their own. Then every row learns the outcome of its digest: the few groups that hold many rows are broadcast, their number being bounded, the others joined.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewright.llm.perfect_hash import DIGEST_BYTES, PerfectHash, digest_words
from rolewright.llm.stage import discard, stage

SHARD_DIGESTS = 1 << 15
#: A group of more than 1 / HOT_GROUPS of all rows (LEAST_HOT at least) is hot, so there are at most HOT_GROUPS of them.
HOT_GROUPS = 1000
LEAST_HOT = 100
_INDEX = "shard long, sizes array<long>, bits binary, left binary, digests binary, ids binary, places binary, counts binary"
_FOUND = "digest binary, keep_id long, keep_place long, n long, known boolean"
_NO_ID = np.iinfo(np.int64).min


def normalised(text: Column) -> Column:
    """Every stretch of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, digest``: a row for each document. ``place`` tells rows of one id apart and is only stable once the frame is staged."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_place, n``: the distinct digests. The smallest id stays, null ids last; of rows with one id the first place."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    found = rows.groupBy("digest").agg(first, F.count("*").alias("n"))
    return found.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("keep_place"), "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards).cast("long"))


def _bytes(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy()


def _built(table: pa.Table) -> pa.Table:
    words = digest_words(_bytes(table["digest"]))
    function = PerfectHash.build(words)
    slot = function.number(words)
    order = np.argsort(slot)
    columns = {
        "shard": [table["shard"][0].as_py()], "sizes": [function.sizes.tolist()], "bits": [function.bits.tobytes()], "left": [function.left.tobytes()],
        "digests": [words[order].tobytes()], "ids": [_numbers(table["keep_id"])[order].tobytes()], "places": [_numbers(table["keep_place"])[order].tobytes()], "counts": [_numbers(table["n"])[order].tobytes()],
    }
    return pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "sizes" else None) for k, v in columns.items()})


def build_history(found: DataFrame, shards: int) -> DataFrame:
    """The index over ``groups``: one row a shard."""
    return found.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_built, _INDEX)


def _looked_up(index: pa.Table, probes: pa.Table) -> pa.Table:
    """A row for every slot of the shard, which counts the probes of its digest in, and one for every probe without a slot."""
    words = digest_words(_bytes(probes["digest"]))
    n = _numbers(probes["n"])
    member = np.zeros(len(words), bool)
    out = []
    if index.num_rows:
        row = {k: index[k][0].as_py() for k in index.schema.names}
        function = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64), digest_words(row["left"]))
        slots = digest_words(row["digests"])
        ids, places, counts = (np.frombuffer(row[k], np.int64) for k in ("ids", "places", "counts"))
        slot = function.number(words)
        member = (slot >= 0) & (slots[np.maximum(slot, 0)] == words).all(1)
        counts = counts.copy()
        counts[slot[member]] += n[member]
        out.append((slots, ids, places, counts, np.ones(len(slots), bool)))
    out.append((words[~member], _numbers(probes["keep_id"])[~member], _numbers(probes["keep_place"])[~member], n[~member], np.zeros(int((~member).sum()), bool)))
    words, ids, places, counts, known = (np.concatenate(c) for c in zip(*out, strict=True))
    texts = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(0, DIGEST_BYTES * len(words) + 1, DIGEST_BYTES).astype(np.int32)), pa.py_buffer(words.tobytes())])
    return pa.table([texts, pa.array(ids, mask=ids == _NO_ID), pa.array(places), pa.array(counts), pa.array(known)], names=[c.split()[0] for c in _FOUND.split(", ")])


def look_up(history: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """``digest, keep_id, keep_place, n, known`` for every digest of the history and of a batch's ``groups``: a member keeps the history's locator and adds to its
    count, a nonmember (``known`` false) has its own."""
    probes = found.withColumn("shard", _shard(shards))
    return history.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(_looked_up, _FOUND)


def outcomes(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row, from the outcome of its digest."""
    hot_rows = max(LEAST_HOT, -(-total // HOT_GROUPS))
    named = found.select("digest", "keep_id", "keep_place", F.col("n").alias("group_size"))
    hot = F.broadcast(named.where(F.col("group_size") > hot_rows))  # HOT_GROUPS rows at most
    some = rows.join(named.where(F.col("group_size") <= hot_rows).hint("merge"), "digest").unionByName(rows.join(hot, "digest"))
    return some.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row, ``digest`` being the sha256 of the normalised text.

    The rows with an id up to the median (found approximately; any bound gives the same result) are the history, the others the batch that is looked up, so a member of the history always has a
    smaller id there. ``keep_id`` is the smallest id of the rows with an equal text, null only where all of them have null ids; null ids never win over others. One
    row of each group is ``kept``, also where rows are repeated as a whole or share an id. Null texts count as empty ones and are equal to each other. Texts differ if
    a single byte differs after white space is normalised, so white space around a text counts as one space. An empty table has no rows. Other columns
    are ignored, whatever their names.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    bound, total = rows.agg(F.percentile_approx("doc_id", 0.5), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(bound).cast("long"), F.lit(False))
    earlier = stage(groups(rows.where(old)), "history-digests")
    later = stage(groups(rows.where(~old)), "batch-digests")
    shards = max(1, -(-max(earlier.count(), later.count()) // shard_digests))
    history = stage(build_history(earlier, shards), "history")
    found = stage(look_up(history, later, shards), "outcomes")
    discard(earlier, later, history)
    return outcomes(rows, found, total)


def digest(result: DataFrame) -> DataFrame:
    """The rows of ``exact_duplicates`` with the hash in hexadecimal."""
    return result.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
