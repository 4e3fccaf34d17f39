"""Spelling variants by pivotal grams.

The grams of a word are its bigrams, ordered from rare to common over all words. Its prefix is the three rarest of them (and any as rare as the third); among three bigrams two never
overlap, and of all such pairs dynamic programming takes the rarest as the word's pivots. One edit spoils at most one of two disjoint grams. So of two words one edit apart, the one whose prefix ends
earlier in the order has a pivot that the edit leaves alone, and that pivot is in the other's prefix: pivots are joined with prefixes, nothing else is. The position limit of one edit is used to the
full: the edit lies either behind the untouched pivot, then both words are equal up to its end, or before it, then they are equal from its start on; and in what lies on the side of the
edit, either the half next to the pivot or the half away from it is untouched. The join key holds the place, the untouched side and the untouched half, so few words meet that are not
near, however many begin or end alike; what meets is verified.

Words are runs of Latin letters up to U+00FF, so there are at most 90 x 90 bigrams: their counts are the only thing that is sent to every task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewright.llm.stage import discard, stage

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, PREFIX_GRAMS = 2, 3
MIN_LENGTH, MIN_COUNT, SPOIL = 5, 3, 97
#: Words whose keys are made at a time.
KEYED_WORDS = 4096
_KEYS = "pivot boolean, key long, last int, word string"


def spoiled(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one of its code points where ``every`` divides the checksum of id and run."""
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (check % F.length(run)).cast("int")
    return F.when(check % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, spoil: int | None = None) -> DataFrame:
    """``word, n``: the words of all texts and how often they occur. ``spoil`` puts misspellings in, see ``spoiled``."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))
    word = spoiled(F.col("doc_id"), F.col("run"), spoil) if spoil else F.col("run")
    # a run this short is too short with or without a code point
    words = runs.where(F.length("run") >= min_length).select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram: at most 90 x 90 rows, see above."""
    starts = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("word").substr(i, F.lit(GRAM))))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def pivots(ranks: list[int], weights: list[int], prefix: list[int]) -> tuple[int, int]:
    """The two disjoint places among those of the prefix with the least sum of weights. ``best[k]`` is the lightest place up to the k-th; a place
    is paired with the lightest one that ends before it starts."""
    best, found, behind = [], None, -1
    for k, p in enumerate(prefix):
        while behind + 1 < k and prefix[behind + 1] + GRAM <= p:
            behind += 1
        if behind >= 0:
            q = best[behind]
            cost = (weights[q] + weights[p], ranks[q], ranks[p], q, p)
            if found is None or cost < found:
                found = cost
        best.append(p if not best or (weights[p], ranks[p]) < (weights[best[-1]], ranks[best[-1]]) else best[-1])
    return found[-2], found[-1]


def _places(word: str, i: int, slack: int) -> set[str]:
    """Keys of the gram at place i: what is equal in two words if one edit leaves the gram alone. A side of m letters has halves of m // 2 letters next to the gram and the rest
    away from it; the other word's side has up to ``slack`` letters more or fewer."""
    n, end = len(word), i + GRAM
    out = set()
    for m in range(max(0, n - end - slack), n - end + slack + 1):
        inner, outer = m // 2, m - m // 2
        if inner <= n - end:
            out.add(f"{i}<{word[: end + inner]}")
        if 0 < outer <= n - end:
            out.add(f"{i}<{word[:end]}<{word[n - outer :]}")
    for m in range(max(0, i - slack), i + slack + 1):
        inner, outer = m // 2, m - m // 2
        if inner <= i:
            out.add(f"{n - i}>{word[i - inner :]}")
        if 0 < outer <= i:
            out.add(f"{n - i}>{word[:outer]}>{word[i:]}")
    return out


def _keyed(counts: dict[str, int]):
    order = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, KEYED_WORDS):
                role, key, last, words = [], [], [], []
                for word in batch.column(0).slice(start, KEYED_WORDS).to_pylist():
                    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
                    ranks = [order[g] for g in grams]
                    end = sorted(ranks)[PREFIX_GRAMS - 1]
                    prefix = [i for i, r in enumerate(ranks) if r <= end]
                    met = set().union(*(_places(word, i, 1) for i in prefix))
                    own = set().union(*(_places(word, i, 0) for i in pivots(ranks, [counts[g] for g in grams], prefix)))
                    key += [xxhash.xxh3_64_intdigest(k) for k in (*met, *own)]
                    role += [False] * len(met) + [True] * len(own)
                    last += [end] * (len(met) + len(own))
                    words += [word] * (len(met) + len(own))
                hashed = np.array(key, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(role, pa.bool_()), pa.array(hashed), pa.array(last, pa.int32()), pa.array(words, pa.string())], [c.split()[0] for c in _KEYS.split(", ")])

    return keyed


def near_words(words: DataFrame) -> DataFrame:
    """``word, other``: all pairs of the given distinct words that differ by one inserted, deleted or replaced code point, both ways round. Words have four
    letters or more: with fewer bigrams than three there are no two disjoint ones for certain."""
    keys = stage(words.select("word").mapInArrow(_keyed(gram_counts(words)), _KEYS), "gram-keys")
    left = keys.where("pivot").select("key", F.col("last").alias("l_last"), F.col("word").alias("l"))
    right = keys.where("not pivot").select("key", F.col("last").alias("r_last"), F.col("word").alias("r"))
    close = (F.col("l_last") <= F.col("r_last")) & (F.abs(F.length("l") - F.length("r")) <= 1) & (F.col("l") != F.col("r")) & (F.levenshtein("l", "r", 1) == 1)
    met = left.hint("merge").join(right, "key").where(close).select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    pairs = stage(met, "near-words")
    discard(keys)
    return pairs.select(F.col("l").alias("word"), F.col("r").alias("other")).unionByName(pairs.select(F.col("r").alias("word"), F.col("l").alias("other")))


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words that have a form: forms of forms, doubling the length of the way each time. A form is at least twice as frequent as its word,
    so no way is longer than 63 and it ends after seven rounds at most."""
    ways = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stage(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        more = now.where("moved").limit(1).count()
        if hasattr(ways, "stage_path"):
            discard(ways)
        ways = now.select("word", "root")
        ways.stage_path = now.stage_path
        if not more:
            return ways


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, spoil: int | None = None
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``min_length`` code points and ``min_count`` occurrences.

    Words are the maximal runs of Latin letters of whole texts with A-Z lower-cased. ``n_near`` words differ by one inserted, deleted or replaced code point; the most
    frequent of them (ties: the smallest in code-point order) is the word's ``form`` if it occurs at least twice as often. ``root`` is where forms of forms end, the word itself if it has no
    form. Null and empty texts have no words; repeated rows count as often as they stand there; ids only matter to ``spoil``, where a null one counts as empty.
    Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    if min_length < PREFIX_GRAMS + GRAM - 1:
        raise ValueError("words of fewer than four letters have no two disjoint bigrams for certain")
    words = stage(vocabulary(docs, id_col, text_col, min_length, min_count, spoil), "words")
    near = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    whole = words.join(best, "word", "left")
    is_form = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    found = stage(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    discard(words)
    roots = _followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
