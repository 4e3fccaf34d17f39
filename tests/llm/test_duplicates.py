"""Line dedup, n-gram join, suffix dedup, decontamination: against brute force."""
import random
import re

import brute as X
import numpy as np
import pyarrow as pa
import pytest

from rolewright.llm import blocks, components, decontaminate, line_dedup, ngram_join, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{X.SF}/documents.parquet").select("doc_id", "text").union(X.table(spark))


def _mixed(draw, n):
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randrange(0, 6)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((5000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("words, percent, cell_rows", [(3, 90, 2048), (5, 80, 16)])
def test_ngram_join_loses_no_link(spark, docs, words, percent, cell_rows):
    rows = docs.union(X.table(spark, _mixed(random.Random(5), 60)))
    expected = X.jaccard_components([tuple(r) for r in rows.collect()], words, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(X.clashing(rows), words, percent, cell_rows=cell_rows).collect()]
    assert X.ordered(got) == X.ordered(expected)


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.similar_documents(X.table(spark, [])).count() == 0


def _cell_block(rows, cell, sets):
    """Record batches of the rows of a cell block as _pairs_apart reads them, cut after ``rows`` rows each; every set is its own root."""
    names = ["cell", "i", "j", "own", "set_id", "n", "root", "mini"]
    mini = [(s << 3).to_bytes(8, "little") * 8 for s in sets]
    n = len(sets)
    table = pa.table([pa.array(x) for x in (cell, [0] * n, [0] * n, [0] * n, sets, [100] * n, sets, mini)], names=names)
    return table.to_batches(max_chunksize=rows)


@pytest.mark.parametrize("rows", [1, 2, 5, 100])
def test_pairs_of_a_single_cell_block_whatever_the_batches(rows):
    draw = random.Random(rows)
    one = sorted(draw.sample(range(1, 50), 12))
    two = sorted(draw.sample(range(50, 99), 3))
    for cell, sets in (([4] * 12, one), ([4] * 12 + [5] * 3, one + two), ([3] * 3 + [4] * 12, two + one)):
        found = ngram_join._pairs_apart(80)(iter(_cell_block(rows, cell, sets)))
        got = {(a, b) for batch in found for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        of_cell = {c: [s for s, k in zip(sets, cell, strict=True) if k == c] for c in set(cell)}
        near = {(a, b) for group in of_cell.values() for a in group for b in group if a < b and 8 * (a ^ b).bit_count() * 180 <= 200 * 20}
        assert got == near and got


def test_candidates_of_a_large_group_of_near_copies_stay_few(spark, monkeypatch):
    draw = random.Random(13)
    vocab = [f"w{i}" for i in range(3000)]
    base, rows = [draw.choice(vocab) for _ in range(120)], []
    for i in range(500):  # few copies are similar enough to the base text, most stay alone
        words = list(base)
        for _ in range(draw.randrange(1, 9)):
            words[draw.randrange(120)] = draw.choice(vocab)
        rows.append((7000 + i, " ".join(words)))
    pairs, plain = [], ngram_join._cell_pairs
    monkeypatch.setattr(ngram_join, "_cell_pairs", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(X.table(spark, rows), 5, 80).collect()]
    assert X.ordered(got) == X.ordered(X.jaccard_components(rows, 5, 80))
    assert len({c for _, _, c in got}) > 200 and pairs[0] < 2 * len(rows)


def _colliding(n):
    """Two sequences of n bytes, n a power of two of 1,024 or more, that collide under every polynomial modulo 2 ** 64 with an odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_long_spans_that_one_polynomial_cannot_tell_apart(spark):
    one, two = _colliding(1024)
    data = np.frombuffer((one + two + one).encode(), np.uint8)
    starts = np.array([0, 1024, 2048])
    found = blocks.Prefix(data).spans(starts, starts + 1024).tolist()
    assert found[0] == found[2] != found[1]
    values = blocks.Prefix(np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64).repeat(2).reshape(-1, 2).T.reshape(-1))
    at = np.arange(0, 2700, 7)
    assert (values.spans(at, at + 300) == values.spans(at + 3000, at + 3300)).all() and len(set(values.runs(300).tolist())) == 3000
    docs = X.table(spark, [(1, f"{one}\n{one}x\n{two}"), (2, f"{two}\n{two}x\n{one}")])
    assert [list(r.removed) for r in line_dedup.remove_repeated_lines(docs, words=None).collect()] == [[], []]
    docs = X.table(spark, [(1, f"{one} same"), (2, f"{two} same")])
    assert {r.component_id for r in ngram_join.similar_documents(docs, 1, 80).collect()} == {1, 2}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 120)}}


@pytest.mark.parametrize("options", [{}, {"batches": 3, "group_rows": 3, "gram": 16, "block_bytes": 700}])
def test_suffix_dedup_equals_brute_force(spark, docs, options):
    draw = random.Random(3)
    base = "".join(draw.choice("abcdefgh ") for _ in range(2500))
    rows = [(7000, "a" * 450), (7001, "ab" * 150), (7002, "q" * 199), (7003, "q" * 199), (7004, "Z" * 200 + "y"), (7005, "k" + "Z" * 200), (7006, "é" * 150), (7006, "é" * 150)]
    for i in range(40):
        s, pad = draw.randrange(2200), lambda: "".join(draw.choice("mnop ") for _ in range(draw.randrange(250)))
        rows.append((7100 + i, pad() + base[s : s + draw.randrange(150, 300)] + pad()))
    every = docs.where("doc_id is null or doc_id < 9009").union(X.table(spark, rows))
    expected = X.kept_bytes([tuple(r) for r in every.collect()], 200)
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(X.clashing(every), **options).collect()]
    assert X.ordered(got) == X.ordered(expected)


def test_suffix_levels_merge_like_a_counter(spark, docs):
    index, rows = suffix_dedup.SuffixIndex(), suffix_dedup.identified(docs)
    for k in range(5):
        index.insert(rows.where(f"pmod(doc, 5) = {k}"))
    assert [level is not None for level in index.levels] == [True, False, True]
    assert sum(level.count() for level in index.levels if level is not None) == suffix_dedup.suffix_array(rows).count()


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(X.table(spark, [])).count() == 0


@pytest.mark.parametrize("test_words, segment", [(2_000_000, 2 << 20), (300, 5000)])
def test_contamination_equals_brute_force(spark, docs, test_words, segment):
    items = [tuple(r) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").collect()]
    items += [(900, "of the"), (901, None), (902, "!"), (None, items[0][1]), (903, items[0][1])]
    extra = [(8000, items[0][1][:90]), (8001, items[1][1] + " " + items[2][1]), (8002, items[3][1].upper())]
    rows = docs.union(X.table(spark, extra))
    expected = X.contaminated([tuple(r) for r in rows.collect()], items)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(X.clashing(rows), tests, test_words=test_words, segment_bytes=segment)).collect()
    assert X.ordered(map(tuple, got)) == X.ordered(expected)


def test_proximity_finds_what_the_phrase_misses(spark):
    tests = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = X.table(spark, [(1, "one two three four extra five six seven eight nine ten"), (2, "ten nine eight seven six five four three two one"), (3, "nothing of it")])
    exact = {r.doc_id: len(r.hit) for r in decontaminate.contamination(docs, tests).collect()}
    near = {r.doc_id: len(r.hit) for r in decontaminate.contamination(docs, tests, slop=1).collect()}
    assert exact == {1: 0, 2: 0, 3: 0} and near == {1: 10, 2: 0, 3: 0}
    assert decontaminate.contamination(docs, tests.limit(0)).where("size(hit) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), tests).count() == 0


@pytest.mark.parametrize("run, gram", [(3, 2), (2, 1), (5, 2)])
def test_line_dedup_equals_brute_force(spark, docs, run, gram):
    draw = random.Random(5)
    lines = [f"line {i}" for i in range(12)] + ["", " ", "LINE 3"]
    rows = [(7000, "a\nb\nc\n"), (7001, "A\n b\nC"), (7002, "\n\n\n\n\n"), (7003, "\n\n\n"), (7004, "a\na\na\na\na"), (7005, "x\n" * 30), (7006, "\n"), (None, "a\nb\nc")]
    rows += [(7100 + i, "\n".join(draw.choice(lines) for _ in range(draw.randrange(12)))) for i in range(60)]
    every = docs.union(X.table(spark, rows))
    named = [tuple(r) for r in every.selectExpr("doc_id", "text", "xxhash64(doc_id, coalesce(text, ''))").collect()]
    got = {(r.doc, r.kept_text, r.n_lines, tuple(sorted(r.removed))) for r in line_dedup.remove_repeated_lines(X.clashing(every), run, gram).collect()}
    assert got == {(h, k, n, tuple(g)) for h, k, n, g in X.removed_lines(named, run)}


def _removed_by_words(rows, run, words):
    """{row hash: removed lines} of rows (doc_id, text, hash of both): runs of ``run`` lines, and shorter ones of ``words`` words."""
    seen, out = set(), {}
    for _, t, h in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        plain = [X.lower(x.strip(" \t\n\v\f\r")) for x in t.removesuffix("\n").split("\n")] if t else []
        gone = set()
        for n in range(1, run + 1):
            for i in range(len(plain) - n + 1):
                w = tuple(plain[i : i + n])
                if any(w) and (n == run or sum(len(re.findall(r"[^ \t\n\v\f\r]+", x)) for x in w) >= words):
                    if w in seen:
                        gone.update(range(i, i + n))
                    seen.add(w)
        out[h] = sorted(gone)
    return out


def test_line_dedup_counts_a_run_by_its_words(spark, docs):
    passage = " ".join(f"word{i}" for i in range(60))
    half, other = (" ".join(f"{k}{i}" for i in range(30)) for k in ("half", "other"))
    rows = [(7000, f"first\n{passage}\nlast"), (7001, f"above\n {passage.upper()}\nbelow\n"), (7002, passage), (7003, f"{half}\n{other}"), (7004, f"x\n{half}\n{other}\ny"), (7005, half), (7006, other + "\n" + passage)]
    every = docs.union(X.table(spark, rows))
    named = [tuple(r) for r in every.selectExpr("doc_id", "text", "xxhash64(doc_id, coalesce(text, ''))").collect()]
    found = line_dedup.remove_repeated_lines(X.clashing(every), words=line_dedup.WORDS).collect()
    assert {r.doc: sorted(r.removed) for r in found} == _removed_by_words(named, 3, 50)
    got = {r.doc_id: (sorted(r.removed), r.kept_text) for r in found if r.doc_id and 7000 <= r.doc_id < 7007}
    assert [got[i][0] for i in range(7000, 7007)] == [[], [1], [0], [], [1, 2], [], [1]]
    assert got[7001][1] == "above\nbelow\n" and got[7002][1] == "" and got[7006][1] == other


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.remove_repeated_lines(X.table(spark, [])).count() == 0
