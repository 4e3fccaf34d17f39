"""Token counts, packing, language ID, toxicity: against the libraries, as round trips, on held-out rows."""
import zlib
from collections import defaultdict

import brute as X
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolewright.llm import language_id, packing, token_counts, toxicity
from rolewright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{X.SF}/documents.parquet").select("doc_id", "text").union(X.table(spark)).cache()


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_token_counts_equal_the_library(docs, block):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    got = [tuple(r) for r in token_counts.count_tokens(X.clashing(docs), block_bytes=block).collect()]
    assert X.ordered(got) == X.ordered(expected)


def test_packing_is_a_round_trip_with_little_padding(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(X.clashing(docs.dropDuplicates(["doc_id"]))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = {r.doc_id: r.text for r in docs.dropDuplicates(["doc_id"]).collect()}
    assert set(texts) == set(by_doc)
    for doc_id, text in texts.items():
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * total


def test_best_cuts_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        positions = [0, *np.cumsum(rng.integers(1, 9, rng.integers(1, 14))).tolist()]
        penalties = [0, *rng.integers(0, 5, len(positions) - 1).tolist()]
        best = [0] + [10**9] * (len(positions) - 1)
        for j in range(1, len(positions)):
            for i in range(j):
                if positions[j] - positions[i] <= 12:
                    best[j] = min(best[j], best[i] + penalties[j] + 12 - (positions[j] - positions[i]))
        cuts = packing.best_cuts(positions, penalties, 12)
        cost = sum(penalties[b] + 12 - (positions[b] - positions[a]) for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1 and cost == best[-1]
    assert packing.powers_of_two(13) == [8, 4, 1] and packing.powers_of_two(0) == []


def test_language_id_on_held_out_rows(spark):
    rows = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] > 0.98 and held[1] < 0.01


def test_language_id_of_odd_rows(spark):
    model = language_id.train([b"the cat and the dog " * 3, b"le chat et le chien " * 3] * 40, ["en", "fr"] * 40, np.arange(80) % 5 == 0)
    rows = [(r.lang_pred, r.rejected, 0 <= r.score <= 1) for r in language_id.identify(X.clashing(X.table(spark)).coalesce(1), model).collect()]
    assert len(rows) == len(X.ODD) and rows[0] == rows[1] == rows[2] == ("und", True, True) and all(r[2] for r in rows)
    none = language_id.identify(X.table(spark, [(1, "text")]), language_id.Model()).first()
    assert (none.lang_pred, none.score, none.rejected) == ("und", 0.0, True)
    assert language_id.identify(X.table(spark, []), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty, F.lit(True)).languages == []


def test_grammar_weighs_clauses():
    g = toxicity.grammar()
    insult, threat, target, negation, report, other = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER
    assert g.weigh([other, other]) == 0
    assert g.weigh([insult]) == 1.0
    assert g.weigh([target, other, insult]) == pytest.approx(1.3)
    assert g.weigh([target, other, negation, other, insult]) == pytest.approx(0.6)
    assert g.weigh([negation, other, other, other, insult]) == pytest.approx(1.0)
    assert g.weigh([report, other, insult]) == pytest.approx(0.5)
    assert g.weigh([threat, target]) == pytest.approx(1.2)


def test_toxicity_learns_stems_and_scores(spark):
    words = "the of and in to with on at by from this that for as".split()
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words, 30)) + f" u{i}."
        toxic = i % 5 == 0
        if toxic:
            text += f" Du Blork{rng.choice(['e', 'ig', 'haft'])} bist ein idiot."
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(1000, "Ein BLORKhaftes Ding"), (1001, "nothing"), (1002, None), (1003, "")]
    docs, known = X.table(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.lit(True))
    assert any("blork".startswith(s[:5]) for s in model.stems)
    got = {r.doc_id: r for r in toxicity.score(X.clashing(docs), model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1003].score == got[1001].score
    assert toxicity.score(X.table(spark, []), model).count() == 0
    assert toxicity.fit(X.table(spark, []), known.limit(0), F.lit(True)) == toxicity.Model()


def test_toxicity_learns_markers_of_a_language_with_few_toxic_texts(spark):
    words = "the of and in to with on at by from this that for as".split()
    rng = np.random.default_rng(2)
    rows = []
    for i in range(2000):
        text = " ".join(rng.choice(words, 20)) + f" u{i}."
        # 300 toxic texts of one language, 6 of another; "zweif" stands in four toxic and four clean texts
        text += " Such an idiot." if i < 300 else " Un bocoran del." if i < 306 else ""
        rows.append((i, text + (" zweifel" if 298 <= i < 302 or 1000 <= i < 1004 else "")))
    known = spark.createDataFrame([(i, int(i < 306)) for i in range(2000)], "doc_id long, toxic int")
    stems = toxicity.fit(X.table(spark, rows), known, F.lit(True)).stems
    assert any(s.startswith("boc") for s in stems) and not any(s.startswith("zwe") for s in stems)


def test_toxicity_recall_by_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op7_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = F.avg("predicted").alias("share")
    got = {(r.lang, r.toxic): r.share for r in rows.where("toxic is not null").groupBy("lang", "toxic").agg(share).collect()}
    print(got)
    assert all(got[lang, 1] >= least for lang, least in {"en": 0.9, "fr": 0.8, "es": 0.8, "de": 0.5}.items())
    assert all(got[lang, 0] <= 0.02 for lang in ("en", "fr", "es", "de"))


def test_toxicity_query_on_held_out_rows(spark):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
