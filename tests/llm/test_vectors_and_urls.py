"""Nearest vectors, URL filter, pipeline."""
import brute as X
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolewright.llm import nearest, url_filter


def _truth(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def test_factor_one_is_exact_and_the_default_recalls_enough(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = _truth(ids, x, 20)
    for options in ({"factor": 1.0, "shard_rows": 120, "query_rows": 7, "leaf_rows": 8}, {}):
        got = {}
        for r in nearest.nearest(X.clashing(e.withColumnRenamed("label", "doc")).drop("rank"), F.col("vec_id") % 20 == 0, **options).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        share = np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in t}) / 20 for q, t in truth.items()])
        assert share == 1.0 if options else share >= 0.9
    assert all(abs(a[2] - b[2]) < 1e-12 for q in truth for a, b in zip(sorted(got[q]), truth[q]))


def test_vectors_that_take_no_part_ties_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (20, [0.0, 1.0, 0.0]), (3, [0.5, 0.0]), (None, [1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(100, 160, 3)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 100, 1.0), (4, 103, 1.0), (5, 106, 1.0)]
    assert not [r for r in got if r.query_id == 20]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_url_rules_and_parts(spark):
    model = url_filter.train(url_filter.labelled_table(spark))
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Org"), (5, "x://ORG/q?x#y"), (6, "a://b.com/de/1"), (7, "s://www.example.org/en/1x"), (8, "s://example.org/es/"), (9, "s://badexample.org/es/"),
        (10, "h://x.com/fr/" + "a/" * 20000), (11, "h://com/de/://z"), (12, "://h?://"), (13, "h://a\nb/é"), (None, "h://x.org/"), (5, "x://ORG/q?x#y"),
    ]
    got = url_filter.judge(X.clashing(spark.createDataFrame(rows, "page_id long, url string")), model, url_filter.PRODUCTION_RULES).collect()
    by = {r.page_id: (r.host, r.path[:12], r.rule, r.verdict if r.rule else None) for r in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == ("", "", None, None)
    assert by[4] == ("a.org", "", None, None) and by[5] == ("org", "/q", "org/", "allow") and by[6] == ("b.com", "/de/1", "com/de/", "block")
    assert by[7] == ("www.example.org", "/en/1x", "example.org/en/1", "block") and by[8][2:] == ("example.org/es/", "block") and by[9][2:] == ("org/", "allow")
    assert by[10][2:] == ("com/fr/", "allow") and by[11] == ("com", "/de/://z", "com/de/", "block") and by[12] == ("h", "", None, None) and by[13] == ("a\nb", "/é", None, None)


def test_url_model_tells_apart_what_it_has_not_seen(spark):
    model = url_filter.train(url_filter.labelled_table(spark))
    bad = ["https://cheap-pills.example.net/en/3", "http://www.spam-farm.example.net/de/9", "https://casino-games.example.net/x", "http://free-bets.example.net/en/1"]
    good = ["https://blog.ththan.example.net/en/960", "http://museum-guide.example.net/en/3", "https://therou.example.net/de/474.html", "https://city-library.example.net/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(rows, model).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"] * 4
    plan = url_filter.judge(rows, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_filter.train(url_filter.labelled_table(spark).limit(0)).bias == -1.0
    assert url_filter.judge(rows.limit(0), model).count() == 0


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{X.SF}/documents.parquet")
    more = [(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5), (9001, "12 34", "en", "s", 5), (None, docs.first().text, "en", "s", 1)]
    now = docs.union(spark.createDataFrame(more, docs.schema))
    steps = dict(corpus_pipeline.STAGES)
    after = steps["language ID"](spark, now, X.SF)
    assert after.columns == docs.columns and after.where("doc_id >= 9000").count() == 0 and after.count() >= docs.count()
    named = [tuple(r) for r in after.selectExpr("doc_id", "text", "xxhash64(doc_id, coalesce(text, ''))").collect()]
    lines = steps["line dedup"](spark, after, X.SF).cache()
    expected = [k for _, k, _, g in X.removed_lines(named, 3, 50) if not g or k.strip()]
    assert sorted(r.text for r in lines.collect()) == sorted(expected) and lines.columns == docs.columns
    apart = steps["n-gram Jaccard join"](spark, lines, X.SF).cache()
    groups = {(d if d is not None else -1): c for d, _, c in X.jaccard_components([(r.doc_id, r.text) for r in lines.collect()], 5, 80)}
    assert X.ordered(r.doc_id for r in apart.collect()) == X.ordered(set(groups.values())) and apart.columns == docs.columns
    clean = steps["decontamination"](spark, apart, X.SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").collect()]
    kept = [d for d, *_, hit in X.contaminated([(r.doc_id, r.text) for r in apart.collect()], items) if not hit]
    assert X.ordered(r.doc_id for r in clean.collect()) == X.ordered(kept) and clean.columns == docs.columns
    packed = steps["packing"](spark, clean, X.SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_pipeline_keeps_other_columns_and_one_row_of_a_group_whatever_its_ids(spark):
    words = [f"word{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(reversed(words))
    rows = [(1, text, "a"), (1, near, "b"), (None, other, "c"), (None, other + " end", "d"), (2, "x", "e"), (2, "x", "f"), (3, None, "g"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("lang", F.lit("en"))
    steps = dict(corpus_pipeline.STAGES)
    left = steps["n-gram Jaccard join"](spark, docs, X.SF).collect()
    assert len(left) == 5 and {r.row for r in left} >= {"e", "g", "h"} and len({r.row for r in left} & set("ab")) == len({r.row for r in left} & set("cd")) == 1
    for name in ("language ID", "line dedup", "decontamination"):
        kept = steps[name](spark, docs, X.SF)
        assert kept.columns == docs.columns and {r.row for r in kept.collect()} <= set("abcdefgh")
    for name in ("language ID", "line dedup", "n-gram Jaccard join", "decontamination", "packing"):
        assert steps[name](spark, docs.limit(0), X.SF).count() == 0


@pytest.mark.parametrize("factor", [1.0, 0.6])
def test_ties_among_distinct_vectors_go_to_the_smaller_ids(spark, factor):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0] + [0.0] * 7)] + [(i, [1.0, *rng.normal(size=7).tolist()]) for i in rng.permutation(np.arange(1, 400)).tolist()]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, factor=factor).orderBy("rank").collect()
    assert [r.score for r in got] == [1.0] * 20
    assert [r.vec_id for r in got] == list(range(1, 21)) if factor == 1 else len({r.vec_id for r in got}) == 20
