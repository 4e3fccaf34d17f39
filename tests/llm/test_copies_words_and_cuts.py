"""Exact dedup, spelling variants and fill-in-middle: against brute force and round trips."""
import hashlib
import random
import re
import zlib
from collections import Counter

import brute as X
import numpy as np
import pytest

from rolewright.llm import exact_dedup, fill_in_middle, spelling
from rolewright.llm.perfect_hash import PerfectHash
from rolewright.llm.wavelet import WaveletMatrix


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{X.SF}/documents.parquet").select("doc_id", "text").union(X.table(spark))


# --- exact dedup


def _digests(n, seed=1):
    return np.random.default_rng(seed).integers(0, 1 << 64, (n, 4), np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash_numbers_its_digests_without_gaps(n):
    words = _digests(n)
    assert sorted(PerfectHash.build(words).number(words).tolist()) == list(range(n))


def test_perfect_hash_numbers_digests_that_no_row_tells_apart():
    words = _digests(40)
    words[:, :3] = words[0, :3]  # the places only look at three of the four words
    function = PerfectHash.build(words)
    assert len(function.left) == 40 and sorted(function.number(words).tolist()) == list(range(40))
    assert (function.number(_digests(40, 2)) == -1).all()


def _kept(rows):
    plain = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, t in plain:
        groups.setdefault(t, []).append(d)
    least = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    seen, out = set(), []
    for d, t in plain:
        first = d == least[t] and t not in seen
        if first:
            seen.add(t)
        out.append((d, least[t], len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return out


COPIES = [
    (1, "one text"), (2, "one  text"), (3, "one\ttext"), (4, "One text"), (5, " one text"), (6, "one text "), (7, "one text"), (7, "one text"), (None, "one text"),
    (None, "nobody"), (None, "nobody"), (8, "nobody "), (9, "a b"), (10, "a b"), (11, None), (12, ""), (13, " "), (14, "\n\n"), (1, "one text"),
]


@pytest.mark.parametrize("shard_digests", [1 << 15, 7])
def test_exact_duplicates_equal_brute_force(spark, docs, shard_digests):
    rows = docs.union(X.table(spark, COPIES)).union(X.table(spark, [(20_000 + i, "hot\ntext") for i in range(300)]))
    got = exact_dedup.digest(exact_dedup.exact_duplicates(X.clashing(rows), shard_digests=shard_digests)).collect()
    assert X.ordered(map(tuple, got)) == X.ordered(_kept([tuple(r) for r in rows.collect()]))


@pytest.mark.parametrize("rows", [[], [(None, "a"), (None, "a"), (None, None)], [(5, "x")], [(-3, "x"), (4, "x")]])
def test_exact_duplicates_of_small_tables(spark, rows):
    got = exact_dedup.digest(exact_dedup.exact_duplicates(X.table(spark, rows))).collect()
    assert X.ordered(map(tuple, got)) == X.ordered(_kept(rows))


def test_a_lookup_tells_members_from_nonmembers(spark):
    old, new = (exact_dedup.groups(exact_dedup.digests(X.table(spark, rows))) for rows in ([(1, "a"), (2, "b"), (9, "a")], [(5, "a"), (6, "c"), (7, "c")]))
    found = exact_dedup.look_up(exact_dedup.build_history(old, 3), new, 3).collect()
    assert sorted((r.keep_id, r.n, r.known) for r in found) == [(1, 3, True), (2, 1, True), (6, 2, False)]


# --- spelling variants


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, spoil=97, least=5, often=3):
    n = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = X.lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    cut = {}  # a word and each word without one of its letters: two words one edit apart share one of them
    for w in n:
        for i in range(len(w)):
            cut.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        cut.setdefault(w, set()).add(w)
    near = {w: set() for w in n}
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if _one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("spoil", [97, 3])
def test_spelling_variants_equal_brute_force(spark, docs, spoil):
    rows = docs.union(X.table(spark, [(None, "Spelling spelling spelin spellin spellin ÀÉÎõü Àéîõü àéîõü ßßßßß ßßßßß ßßßßß aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa")]))
    got = [tuple(r) for r in spelling.spelling_variants(X.clashing(rows), spoil=spoil).collect()]
    assert X.ordered(got) == X.ordered(_variants([tuple(r) for r in rows.collect()], spoil)) and len(got) > 1000


def test_near_words_of_random_words_lose_no_pair(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("abc") for _ in range(draw.randrange(4, 9))) for _ in range(900)} | {"a" * k for k in range(4, 9)} | {"étété", "étét", "eteté"}
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if _one_edit(a, b)}


def test_pivots_are_the_lightest_disjoint_pair():
    draw = random.Random(6)
    for _ in range(500):
        n = draw.randrange(3, 9)
        weights = [draw.randrange(1, 12) for _ in range(n)]
        prefix = sorted(draw.sample(range(n), draw.randrange(3, n + 1)))
        q, p = spelling.pivots(weights, weights, prefix)
        least = min(weights[a] + weights[b] for a in prefix for b in prefix if b - a >= 2)
        assert p - q >= 2 and {p, q} <= set(prefix) and weights[p] + weights[q] == least


def test_roots_follow_long_ways(spark):
    ladder = [("abcdefgh"[:5] + "x" * k, 3 << k) for k in range(9)]  # each is one letter longer and twice as frequent
    rows = [(1, " ".join(" ".join([w] * n) for w, n in ladder))]
    got = {r.word: r for r in spelling.spelling_variants(X.table(spark, rows)).collect()}
    assert {got[w].root for w, _ in ladder} == {ladder[-1][0]} and got[ladder[-1][0]].form is None and got[ladder[0][0]].form == ladder[1][0]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "1234 !?")]])
def test_spelling_variants_without_words(spark, rows):
    assert spelling.spelling_variants(X.table(spark, rows)).count() == 0


def test_spelling_variants_refuse_words_too_short_for_two_pivots(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(X.table(spark, []), min_length=3)


# --- fill-in-middle


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 4096])
def test_wavelet_matrix_equals_counting(n):
    codes = np.random.default_rng(n).integers(0, 6, n).astype(np.uint8)
    matrix, places = WaveletMatrix(codes, 3), np.arange(n + 1)
    for code in range(7):
        assert matrix.rank(code, places).tolist() == np.concatenate(([0], np.cumsum(codes == code))).tolist()
        at = np.flatnonzero(codes == code)
        assert matrix.select(code, np.arange(len(at))).tolist() == at.tolist()
    both = np.flatnonzero((codes == 1) | (codes == 4))
    assert matrix.select_of((1, 4), np.arange(len(both))).tolist() == both.tolist()


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\t-\r]*[\x20\t-\r]|[^\x20\t-\r]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+"}


def _cut(doc_id, text, unit, fim, spm):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


CUTS = [(-5, "a<P>b"), (6, "<S>"), (7, "x\ny<M>"), (8, "<<P\n>S>\n<M"), (9, "\n"), (10, "\n\n\n"), (11, "a\n\nb"), (12, "é\nü\r\n日本\n\U0001f600"), (13, "no end of line"), (14, "S><\nM>\n<")]


@pytest.mark.parametrize("unit, fim, spm, block", [("line", 100, 50, 1 << 20), ("word", 60, 0, 300), ("sentence", 100, 100, 2000)])
def test_fill_in_middle_equals_brute_force_and_comes_back(spark, docs, unit, fim, spm, block):
    rows = docs.union(X.table(spark, CUTS + [(1000 + i, t) for i in range(8) for _, t in CUTS]))
    cut = fill_in_middle.fill_in_middle(X.clashing(rows), unit, fim_percent=fim, spm_percent=spm, block_bytes=block)
    assert X.ordered(map(tuple, cut.collect())) == X.ordered(_cut(*r, unit, fim, spm) for r in rows.collect())
    back = cut.select("doc_id", fill_in_middle.restored(cut.output, cut.form)).collect()
    assert X.ordered(map(tuple, back)) == X.ordered((r.doc_id, r.text or "") for r in rows.collect())


def test_fill_in_middle_of_an_empty_table_and_an_unknown_unit(spark):
    assert fill_in_middle.digest(fill_in_middle.fill_in_middle(X.table(spark, []))).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(X.table(spark, []), "page")
