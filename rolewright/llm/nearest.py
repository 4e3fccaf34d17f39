"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

A vector x of a shard whose largest norm is M gets one more coordinate, sqrt(M^2 - |x|^2), a query gets 0 there; then the nearest by Euclidean distance is the one with
the largest inner product, and the triangle inequality holds. A node splits its vectors at the median distance from a vantage point. A query at
distance d visits the other side of the median m only if |m - d| <= factor * (distance of its k-th best so far): factor 1 is exact, less prunes more.
Queries walk a tree together, so that distances are matrix products.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
LEAF_ROWS = 192
FACTOR = 0.6
_MARGIN = 4
_FOUND = "query_id long, vec_id long, score double"


@dataclass
class _Node:
    rows: np.ndarray | None = None
    vantage: int = 0
    median: float = 0.0
    near: _Node | None = None
    far: _Node | None = None


class Tree:
    """A vantage-point tree over distinct vectors."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x, self.leaf_rows = vectors, leaf_rows
        squares = (vectors**2).sum(1)
        self.bound = float(squares.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.bound - squares, 0))
        self.root = self._build(np.arange(len(vectors)))

    def _apart(self, rows: np.ndarray, p: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.bound - 2 * (self.x[rows] @ self.x[p] + self.extra[rows] * self.extra[p]), 0))

    def _build(self, rows: np.ndarray) -> _Node:
        if len(rows) <= self.leaf_rows:
            return _Node(rows)
        vantage = int(rows[self._apart(rows, int(rows[0])).argmax()])
        apart = self._apart(rows, vantage)
        median = float(np.median(apart))
        inner = apart < median
        if not inner.any():
            inner = apart <= median
        if inner.all():  # all as far: no vantage point can tell them apart
            return _Node(rows)
        return _Node(None, vantage, median, self._build(rows[inner]), self._build(rows[~inner]))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (-1: none) and inner products of the k best found for each query."""
        self.q, self.k, self.factor = queries, k, factor
        self.norms = (queries**2).sum(1)
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.dropped = np.full(len(queries), -np.inf)
        self._visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def ties(self) -> dict[int, np.ndarray]:
        """After ``search``: for the queries whose k-th best score others may equal, all row numbers with that score or a better one that the same search reaches. Products of
        matrices are not exact to the last bit, hence the small allowance."""
        least = self.best.min(1)
        allowance = 1e-9 * np.sqrt(self.norms * self.bound)
        at = np.flatnonzero(np.isfinite(least) & (self.dropped >= least - allowance))
        self.floor, self.tied = least - allowance, {i: [] for i in at.tolist()}
        self._collect(self.root, at)
        return {i: np.concatenate(rows) for i, rows in self.tied.items() if rows}

    def _collect(self, node: _Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            hits = self.q[at] @ self.x[node.rows].T >= self.floor[at][:, None]
            for i, hit in zip(at.tolist(), hits, strict=True):
                if hit.any():
                    self.tied[i].append(node.rows[hit])
            return
        apart = np.sqrt(np.maximum(self.norms[at] + self.bound - 2 * (self.q[at] @ self.x[node.vantage]), 0))
        inner = apart < node.median
        near = np.abs(node.median - apart) <= self._reach(at)
        self._collect(node.near, at[inner | near])
        self._collect(node.far, at[~inner | near])

    def _reach(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(self.norms[at] + self.bound - 2 * self.best[at].min(1), 0)) * self.factor + 1e-9

    def _visit(self, node: _Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            score = np.concatenate((self.best[at], self.q[at] @ self.x[node.rows].T), 1)
            rows = np.concatenate((self.rows[at], np.broadcast_to(node.rows, (len(at), len(node.rows)))), 1)
            split = np.argpartition(-score, self.k - 1, 1)
            top, rest = split[:, : self.k], split[:, self.k :]
            self.dropped[at] = np.maximum(self.dropped[at], np.take_along_axis(score, rest, 1).max(1, initial=-np.inf))
            self.best[at], self.rows[at] = np.take_along_axis(score, top, 1), np.take_along_axis(rows, top, 1)
            return
        apart = np.sqrt(np.maximum(self.norms[at] + self.bound - 2 * (self.q[at] @ self.x[node.vantage]), 0))
        inner = apart < node.median
        self._visit(node.near, at[inner])
        self._visit(node.far, at[~inner])
        gap = np.abs(node.median - apart)
        self._visit(node.far, at[inner & (gap <= self._reach(at))])
        self._visit(node.near, at[~inner & (gap <= self._reach(at))])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector that is not empty, not zero and has only finite components. Of rows with
    one id the one with the largest vector counts (compared component by component)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return sound.groupBy("vec_id").agg(F.max("v").alias("v"))


def _search(k: int, factor: float, leaf_rows: int):
    def search(table: pa.Table) -> pa.Table:
        ids, asks = table["vec_id"].to_numpy(), table["ask"].to_numpy(zero_copy_only=False)
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        base, base_ids = x[~asks], ids[~asks]
        ask, ask_ids = x[asks], ids[asks]
        if not len(base) or not len(ask):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.lexsort((base_ids, *base.T[::-1]))
        base, base_ids = base[order], base_ids[order]
        starts = np.flatnonzero(np.concatenate(([True], (base[1:] != base[:-1]).any(1))))
        stops = np.append(starts[1:], len(base))
        # copies: an answer takes at most k of them, and one more if the query is among them
        stops = np.minimum(stops, starts + k + 1)
        tree = Tree(base[starts], leaf_rows)
        found, _ = tree.search(ask, min(k + _MARGIN, len(starts)), factor)
        tied = tree.ties()
        out_q, out_v, out_s = [], [], []
        for i in range(len(ask)):
            rows = np.union1d(found[i][found[i] >= 0], tied[i]) if i in tied else found[i][found[i] >= 0]
            each = stops[rows] - starts[rows]
            at = np.repeat(starts[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
            score = np.repeat((base[starts[rows]] * ask[i]).sum(1), each)
            other = base_ids[at] != ask_ids[i]
            at, score = at[other], score[other]
            top = np.lexsort((base_ids[at], -score))[:k]
            out_q.append(np.full(len(top), ask_ids[i]))
            out_v.append(base_ids[at[top]])
            out_s.append(score[top])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return search


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector for which ``asks`` (a condition on ``vec_id``) holds, the ``k`` other vectors with
    the largest inner products that were found, ties to the smaller id.

    Every usable vector is in the tree of one shard (see ``usable``); a shard holds about ``shard_rows``, and each block of about ``query_rows`` queries
    meets each shard once. Vectors of different dimension are not compared. A query with fewer than ``k`` others has fewer rows. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    n, q = rows.agg(F.count("*"), F.count_if(asks)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // query_rows))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("long")), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks).cast("long"))
    tagged = rows.select("vec_id", "v", F.size("v").alias("dim"), F.lit(False).alias("ask"), shard.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    asked = rows.where(asks).select("vec_id", "v", F.size("v").alias("dim"), F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), block.alias("block"))
    found = tagged.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(_search(k, factor, leaf_rows), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
