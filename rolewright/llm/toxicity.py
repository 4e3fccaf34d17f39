"""Toxicity from a weighted finite-state grammar over the clauses of a text.

Words are mapped to classes: insult, threat, target, negation, reported speech, other. Small transducers read the classes of a clause and give
weights; composed, they walk in step, so that a clause is scored once: an insult or threat counts, a target beside it adds, negation just before it and
reported speech in the clause take away. The insult class is a list of word beginnings, part stated, part learned from labelled
documents. A logistic curve turns the sum over clauses into a score.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm.stage import stage

TRAIN_ROWS = 4000
STEM_CHARS = (3, 4, 5, 6, 7, 8)
#: A learned stem stands in so many toxic texts at least, in this share of its texts, and by chance alone no more often than this.
STEM_TEXTS, STEM_PURITY, STEM_CHANCE = 4, 0.97, 0.001
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Whole words by class; insults are beginnings of words as well.
INSULTS = ("idiot", "moron", "stupid", "imbecil", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "dumbass", "retard")
WORDS: Mapping[int, tuple[str, ...]] = {
    THREAT: ("kill", "murder", "strangle", "töten", "umbringen", "tuer", "matar"),
    TARGET: ("you", "your", "youre", "they", "them", "he", "she", "du", "dein", "ihr", "tu", "toi", "vous", "tú", "usted", "ellos"),
    NEGATION: ("not", "never", "isnt", "arent", "nicht", "kein", "keine", "jamais", "nunca"),
    REPORT: ("said", "says", "quoted", "reported", "according", "sagte", "zitierte", "déclaré", "selon", "dijo", "según"),
}

_WORD = B.byte_set((65, 90), (97, 122), (128, 255))
_BREAK = B.byte_set((10, 10), (33, 33), (46, 46), (58, 59), (63, 63))


@dataclass
class Transducer:
    """Moves (state, class) -> (state, weight); a class without a move keeps the state for nothing. ``last`` adds a weight by state at the end."""

    moves: Mapping[tuple, tuple]
    last: Mapping = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: int):
        return self.moves.get((state, symbol), (state, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes in step; states are pairs and weights add. Only pairs that can be reached are built."""
        start = (self.start, other.start)
        moves, last, todo, seen = {}, {}, [start], {start}
        while todo:
            state = todo.pop()
            last[state] = self.last.get(state[0], 0.0) + other.last.get(state[1], 0.0)
            for symbol in range(6):
                (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
                moves[state, symbol] = ((a, b), x + y)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(moves, last, start)

    def weigh(self, symbols: list[int]) -> float:
        state, total = self.start, 0.0
        for symbol in symbols:
            state, weight = self.step(state, symbol)
            total += weight
        return total + self.last.get(state, 0.0)


def grammar() -> Transducer:
    """The composed clause grammar. Weights: insult 1, threat 0.6 and 0.6 more at a target, target and insult 0.3, negation within three
    words before an insult -0.7, reported speech in a clause with either -0.5."""
    insult = Transducer({(0, INSULT): (0, 1.0)})
    threat = Transducer({(0, THREAT): (1, 0.6), (1, TARGET): (2, 0.6)})
    target = Transducer({(0, TARGET): (1, 0.0), (0, INSULT): (2, 0.0), (1, INSULT): (3, 0.3), (2, TARGET): (3, 0.3)})
    fading = {(s, c): (s - 1, 0.0) for s in (1, 2, 3) for c in (OTHER, TARGET, REPORT, THREAT)}
    negation = Transducer(fading | {(s, NEGATION): (3, 0.0) for s in range(4)} | {(s, INSULT): (0, -0.7) for s in (1, 2, 3)})
    report = Transducer({(0, REPORT): (1, 0.0), (0, INSULT): (2, 0.0), (0, THREAT): (2, 0.0), (1, INSULT): (3, -0.5), (1, THREAT): (3, -0.5), (2, REPORT): (3, -0.5)})
    return insult.compose(threat).compose(target).compose(negation).compose(report)


@dataclass
class Model:
    stems: tuple[str, ...] = INSULTS
    bias: float = -3.0
    slope: float = 6.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * (1 - np.exp(-np.maximum(evidence, 0))))))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case."""
    low = B.lower_ascii(data)
    if len(low) > 1:
        wide = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][wide] += 0x20
    return low


class _Classes:
    """Class of every word of a block by hashes of word beginnings and whole words."""

    def __init__(self, stems: tuple[str, ...]):
        self.stems = self._by_length(stems)
        self.words = {c: self._by_length(w) for c, w in WORDS.items()}

    @staticmethod
    def _by_length(words: tuple[str, ...]) -> dict[int, np.ndarray]:
        found: dict[int, list[int]] = {}
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            found.setdefault(len(raw), []).append(int(B.Prefix(raw).spans(np.array([0]), np.array([len(raw)]))[0]))
        return {n: np.sort(np.array(h, np.uint64)) for n, h in found.items()}

    @staticmethod
    def _among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values

    def __call__(self, prefix: B.Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        classes, lengths = np.zeros(len(starts), np.int8), ends - starts
        whole = prefix.spans(starts, ends)
        for c, tables in self.words.items():
            for n, table in tables.items():
                at = np.flatnonzero(lengths == n)
                classes[at[self._among(table, whole[at])]] = c
        for n, table in self.stems.items():
            at = np.flatnonzero(lengths >= n)
            classes[at[self._among(table, prefix.spans(starts[at], starts[at] + n))]] = INSULT
        return classes


def evidence(data: np.ndarray, offsets: np.ndarray, classes: _Classes, rules: Transducer) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """Sum of the clause weights of each row, and (row, first byte, end byte, weight) of the clauses that matched."""
    low = folded(data)
    starts, ends = B.word_spans(low, offsets, _WORD)
    total, matched = np.zeros(len(offsets) - 1), []
    if not len(starts):
        return total, matched
    kind = classes(B.Prefix(low), starts, ends)
    hot = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hot):
        return total, matched
    breaks = np.unique(np.concatenate((np.flatnonzero(_BREAK[low]), offsets[1:])))
    clause = np.searchsorted(breaks, starts)
    for c in np.unique(clause[hot]).tolist():
        a, b = np.searchsorted(clause, (c, c + 1))
        weight = rules.weigh(kind[a:b].tolist())
        row = int(np.searchsorted(offsets, starts[a], "right")) - 1
        total[row] += max(weight, 0.0)
        matched.append((row, int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row]), weight))
    return total, matched


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many labelled texts of either kind some word begins with a stem, counted per batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        data, offsets = B.text_bytes(batch.column(0))
        for r, toxic in enumerate(batch.column(1).to_pylist()):
            low = folded(data[offsets[r] : offsets[r + 1]])
            starts, ends = B.word_spans(low, np.array([0, len(low)]), _WORD)
            raw = low.tobytes()
            words = {raw[a:b].decode("utf-8", "ignore") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
            for stem in {w[:n] for w in words for n in STEM_CHARS if len(w) >= n}:
                counts.setdefault(stem, [0, 0])[bool(toxic)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["stem", "toxic", "clean"])


def marks_toxic(toxic: int, clean: int) -> Column:
    """Whether a stem marks toxic texts, by its columns ``toxic`` and ``clean``; of all texts so many are either. That a stem which has nothing to do with the label is so much on one side
    has, by Chernoff's bound on the binomial tail, a chance of STEM_CHANCE at most. No share of all toxic texts is asked for: markers of a language with few of them are learned too."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    base = toxic / (toxic + clean)
    against = t * F.log(t / ((t + c) * F.lit(base))) + F.when(c > 0, c * F.log(c / ((t + c) * F.lit(1 - base)))).otherwise(0.0)
    return (t >= STEM_TEXTS) & (t >= STEM_PURITY * (t + c)) & (t > base * (t + c)) & (against >= -np.log(STEM_CHANCE).item())


def choose_stems(rows: list[tuple[str, int]]) -> tuple[str, ...]:
    """Of (stem, toxic texts) that mark toxic texts: the shortest, each made longer as long as
    one longer stem stands for nearly all its texts, so that a stem says no less than the labels support."""
    good = dict(rows)
    chosen: set[str] = set()
    for stem in sorted(good, key=lambda s: (len(s), s)):
        if any(stem[:n] in good for n in STEM_CHARS if n < len(stem)):
            continue
        while longer := [s for s in good if len(s) == len(stem) + 1 and s.startswith(stem) and good[s] >= 0.95 * good[stem]]:
            stem = max(longer, key=lambda s: (good[s], s))
        chosen.add(stem)
    return tuple(sorted(chosen))


def fit(docs: DataFrame, labels: DataFrame, learn_where: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Insult stems and curve from at most about ``train_rows`` labelled documents of either kind (the documented bound of the sample), which a
    hash of the id picks among those that satisfy ``learn_where``. Null labels, ids and texts teach nothing; a document with several labels has the highest.
    Texts that are equal count once."""
    known = labels.where(learn_where & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    picked = known.where(draw < F.when(F.col("toxic"), min(1.0, train_rows / max(n.get(True, 0), 1))).otherwise(min(1.0, train_rows / max(n.get(False, 0), 1)))).limit(3 * train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").repartition(16)
    sample = stage(sample, "labelled-texts")
    toxic, clean = sample.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)), F.coalesce(F.sum((~F.col("toxic")).cast("int")), F.lit(0))).first()
    if not toxic or not clean:
        return Model()
    counted = sample.mapInArrow(_beginnings, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counted.where(marks_toxic(toxic, clean)).select("stem", "toxic")  # at most a quarter of the different stems of the sample's toxic texts
    stems = tuple(sorted(set(INSULTS) | set(choose_stems([tuple(r) for r in often.collect()]))))
    seen = _scored(sample, stems).toArrow()
    x, y = seen["evidence"].to_numpy(), seen["toxic"].to_numpy(zero_copy_only=False).astype(float)
    x = 1 - np.exp(-np.maximum(x, 0))
    weight = np.where(y > 0, n[True] / toxic, n[False] / clean)
    w = np.array([-2.0, 4.0])
    features = np.stack((np.ones(len(x)), x), 1)
    for _ in range(25):  # Newton's method; the ridge keeps separable samples finite
        p = 1 / (1 + np.exp(-features @ w))
        gradient = features.T @ (weight * (p - y)) + 0.1 * w
        hessian = features.T @ (features * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return Model(stems, float(w[0]), float(max(w[1], 0.1)))


def _scored(sample: DataFrame, stems: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, rules = _Classes(stems), grammar()
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 0):
                total, _ = evidence(data, offsets, classes, rules)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(total)], ["toxic", "evidence"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic boolean, evidence double")


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``doc_id, score, predicted, n_clauses, clauses`` for every row: whole texts, one scan, no shuffle.

    ``clauses`` lists the matched clauses as (start, stop, weight) in bytes. Null and empty texts and texts without matches have the score of no evidence.
    Repeated rows give repeated rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, rules = _Classes(model.stems), grammar()
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 1, block_bytes):
                total, matched = evidence(data, offsets, classes, rules)
                lists: list[list] = [[] for _ in range(part.num_rows)]
                for row, a, b, w in matched:
                    lists[row].append({"start": a, "stop": b, "weight": w})
                s = model.score(total)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(list(map(len, lists)), pa.int32()), pa.array(lists, kind)],
                    ["doc_id", "score", "predicted", "n_clauses", "clauses"],
                )

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_clauses int, clauses array<struct<start: int, stop: int, weight: double>>")
