"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy.

Subwords are the 3- and 4-byte stretches of a text in which ASCII letters are lower-cased and everything else in ASCII is a
space. Their embeddings are averaged and a linear layer gives the scores of the languages. Because both steps are linear, a
trained model is kept as one table of scores per bucket. A temperature and a rejection bound are set on sampled
documents that the training left out.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm import wordpieces as WP

BUCKET_BITS = 16
WIDTH = 8
TRAIN_ROWS = 4000
SNIPPETS = 6
SNIPPET_BYTES = 240
SIZES = (3, 4)
_FACTORS = {3: 0x9E3779B1, 4: 0x85EBCA6B}
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_ASCII_LETTER = B.byte_set((65, 90), (97, 122))


@dataclass
class Model:
    """Scores per bucket and language, their bias, the temperature and the least score that is accepted."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BUCKET_BITS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    least_score: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: buckets at every place of the padded block, and each row's first place and the one after its last."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = _PLAIN[data]
    first = offsets[:-1] + np.arange(n)  # the space before the row
    wide = padded.astype(np.uint32)
    value = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    for size in SIZES:
        if size == 4:
            value = value[:-1] | wide[3:] << np.uint32(24)
        places = np.maximum(lengths + 2 - size + 1, 0)
        yield (value * np.uint32(_FACTORS[size])) >> np.uint32(32 - BUCKET_BITS), first, first + places


def row_means(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the bucket scores of each row by language, and the number of subwords."""
    n, k = len(offsets) - 1, len(model.languages)
    sums, counts = np.zeros((n, k)), np.zeros(n)
    for buckets, first, after in subwords(data, offsets):
        counts += after - first
        for c in range(k):
            run = np.zeros(len(buckets) + 1)
            np.cumsum(model.table[c][buckets], out=run[1:])
            sums[:, c] += run[after] - run[first]
    return sums, counts


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words from all over each text, at places drawn from a hash of the row."""
    for batch in batches:
        langs, snips, owners = [], [], []
        data, offsets = B.text_bytes(batch.column(1))
        for i, (seed, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            draw = np.random.default_rng(abs(seed))
            row = data[offsets[i] : offsets[i + 1]]
            for _ in range(SNIPPETS):
                length = int(draw.integers(10, SNIPPET_BYTES))
                at = int(draw.integers(0, max(1, len(row) - length)))
                langs.append(lang)
                owners.append(seed)
                snips.append(row[at : at + length].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(langs, pa.string()), pa.array(snips, pa.binary())], ["owner", "lang", "snippet"])


def train(examples: list[bytes], langs: list[str], check: np.ndarray, seed: int = 7, epochs: int = 4, batch: int = 48, rate: float = 4.0) -> Model:
    """Stochastic gradient descent on the examples where ``check`` is false; the others set temperature and rejection."""
    names = sorted(set(langs))
    if not names:
        return Model()
    k, y = len(names), np.searchsorted(names, langs)
    data, offsets = np.frombuffer(b"".join(examples), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in examples])))
    features = list(subwords(data, offsets))
    draw = np.random.default_rng(seed)
    emb = draw.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    out, bias = draw.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, k)), np.zeros(k)
    learn = np.flatnonzero(~check)
    steps, done = epochs * (len(learn) // batch + 1), 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(learn), len(learn) // batch + 1):
            if not len(rows):
                continue
            parts = [b[B.spread(first[rows], after[rows] - first[rows])] for b, first, after in features]
            owner = np.concatenate([np.repeat(np.arange(len(rows)), (after - first)[rows]) for _, first, after in features])
            buckets = np.concatenate(parts)
            count = np.maximum(np.bincount(owner, minlength=len(rows)), 1)
            mean = np.stack([np.bincount(owner, emb[buckets, d], len(rows)) for d in range(WIDTH)], 1) / count[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            step = rate * (1 - done / steps)
            g = p @ out.T / count[:, None]
            out -= step * mean.T @ p / len(rows)
            bias -= 0.05 * step * p.mean(0)
            used, where = np.unique(buckets, return_inverse=True)
            for d in range(WIDTH):
                emb[used, d] -= step * np.bincount(where, g[owner, d], len(used))
            done += 1
    model = Model(names, np.ascontiguousarray((emb @ out).T.astype(np.float32)), bias)
    seen = np.flatnonzero(check) if check.any() else learn
    sums, counts = row_means(data, offsets, model)
    means = sums[seen] / np.maximum(counts[seen], 1)[:, None]

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(model.probabilities(means)[np.arange(len(seen)), y[seen]] + 1e-12).mean())

    model.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    p = model.probabilities(means)
    right = p.argmax(1) == y[seen]
    model.least_score = min(0.5, float(np.quantile(p.max(1)[right], 0.001))) if right.any() else 0.0
    return model


def fit(docs: DataFrame, learn_where: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from about ``train_rows`` documents (the documented bound of the sample) that have a language and satisfy
    ``learn_where``; which ones depends on a hash of their id alone. Stretches of at most 240 bytes from places all over
    those texts reach the driver, six a document."""
    rows = docs.where(learn_where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(id_col)).alias("seed"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    share = train_rows / max(rows.count(), 1)
    sample = rows.where(F.pmod("seed", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)) if share < 1 else rows
    found = sample.mapInArrow(_snippets, "owner long, lang string, snippet binary").toArrow()
    order = np.lexsort((np.arange(found.num_rows), found["owner"].to_numpy()))
    found = found.take(pa.array(order))
    check = (np.abs(found["owner"].to_numpy()) // 1024) % 5 == 0
    return train(found["snippet"].to_pylist(), found["lang"].to_pylist(), check)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row; whole texts, one scan, no shuffle.

    ``lang_pred`` is ``und``, with score 0, for null texts, texts without a letter, and all texts if the model has learned no language. ``rejected``
    marks these and the ones that score below the model's bound. Repeated rows give repeated rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(model.languages)
            data, offsets = B.text_bytes(batch.column(1))
            starts = WP.split_long(data, offsets, block_bytes)
            edges = np.append(starts, len(data))
            owner = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets, "left"))) if len(data) else np.zeros(0, np.int64)
            owner = np.concatenate((owner, np.full(len(starts) - len(owner), n - 1)))
            sums, counts = np.zeros((n, k)), np.zeros(n)
            for i, j in B.row_blocks(edges, block_bytes) if k else ():
                s, c = row_means(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i], model)
                np.add.at(sums, owner[i:j], s)
                np.add.at(counts, owner[i:j], c)
            letters = np.zeros(n, bool)
            for i, j in B.row_blocks(offsets, block_bytes):
                part = data[offsets[i] : offsets[j]]
                run = np.concatenate(([0], np.cumsum(_ASCII_LETTER[part])))
                letters[i:j] = np.diff(run[offsets[i : j + 1] - offsets[i]]) > 0
                wide = np.concatenate(([0], np.cumsum(part >= 128)))
                for r in np.flatnonzero((np.diff(wide[offsets[i : j + 1] - offsets[i]]) > 0) & ~letters[i:j]) + i:
                    letters[r] = any(map(str.isalpha, data[offsets[r] : offsets[r + 1]].tobytes().decode()))
            if k:
                p = model.probabilities(sums / np.maximum(counts, 1)[:, None])
                best = p.argmax(1)
                score = np.where(letters, p[np.arange(n), best], 0.0)
                pred = np.where(letters, np.array(model.languages, object)[best], "und")
            else:
                score, pred = np.zeros(n), np.full(n, "und", object)
            rejected = (pred == "und") | (score < model.least_score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
