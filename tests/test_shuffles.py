"""What a query shuffles and keeps on disk: rows meet where a document, a pair or a candidate already is."""
import itertools
import math
from collections import Counter

import pytest

from rolewright.operators import judge as J
from rolewright.operators import retrieval as R
from rolewright.operators import tailor, triage
from rolewright.plans import feed_queries, judging_queries, text_queries
from rolewright.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df):
    return [line for line in plan(df).splitlines() if "hashpartitioning" in line]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_of_triage_are_not_shuffled_with_their_skills(spark):
    df = text_queries.skill_overlap_triage(spark, SMALL)
    assert dealt(df) and all("hashpartitioning(job_id#" in line and "skill" not in line.split("]")[0].split("hashpartitioning")[1].split(")")[0] for line in dealt(df))


@pytest.mark.parametrize("long", [2, 1000])
@pytest.mark.parametrize("small", [True, False])
def test_shared_skills_of_repeated_null_and_long_owners(spark, monkeypatch, long, small):
    monkeypatch.setattr(triage, "LONG_LIST", long, raising=False)
    if not small:
        monkeypatch.setattr(triage, "is_small", lambda *a: False)
    cvs = [(1, list("abc")), (1, list("cd")), (2, ["a", None, "e"]), (None, list("abc")), (3, list("xyz")), (4, [])]
    held = [(1, list("abcd")), (2, ["a", "e", "e", None]), (2, ["e"]), (None, list("abc")), (5, list("abcdexyz")), (6, None)]
    found = triage.shared_skills(
        spark.createDataFrame(cvs, "cv_id long, skills array<string>"), spark.createDataFrame(held, "job_id long, skills array<string>"), lambda n: n * 0 + 2
    )
    once = lambda pairs, k: [s for o, xs in pairs if o == k for s in dict.fromkeys(xs or [])]
    want = []
    for c, j in itertools.product((1, 2, 3, 4), (1, 2, 5, 6)):
        mine, theirs = Counter(once(cvs, c)), Counter(once(held, j))
        shared = sorted(s for s in mine if s for _ in range(mine[s] * theirs[s]))
        want += [(c, j, len(shared), shared)] if len(shared) >= 2 else []
    assert rows(found) == sorted(want) and any(len(w[3]) > len(set(w[3])) for w in want)


def test_arriving_postings_stay_with_what_is_made_of_them(spark, tmp_path, monkeypatch):
    found = []
    shared = triage.shared_skills
    monkeypatch.setattr(jobs, "shared_skills", lambda cv, held, threshold: found.append(dealt(held)) or shared(cv, held, threshold))
    got = feed_queries.stream_triage(spark, SMALL)
    # one shuffle of the texts, by posting; neither its hits nor its skills move
    assert len(found) == 3 and all(len(x) == 1 and "REPARTITION_BY_NUM" in x[0] for x in found)
    assert got.count() == got.distinct().count() > 0


def test_terms_of_a_line_are_made_where_its_document_is(spark, monkeypatch):
    made = spark.createDataFrame([(1, 0, "alpha beta alpha"), (1, 1, "beta gamma"), (2, 0, "the"), (3, 5, None), (4, 1, "alphabet"), (5, 0, "zed"), (5, 0, "zed")], "job_id long, chunk_no int, text string")
    kept = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: kept.append(plan(df)) or cut(df))
    terms, sums = R._term_lists(made, "job_id", "chunk_no", "a")
    lines = kept[-1].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    below = [list(itertools.takewhile(lambda line, i=i: depth(line) > depth(lines[i]), lines[i + 1 :])) for i in at]
    # what is exploded, is so above the shuffle
    assert at and "Generate" in kept[-1] and not any("Generate" in line for part in below for line in part)
    whole = R._term_lists(made.select("job_id", "chunk_no", R.line_terms(R.F.col("text")).alias("terms")), "job_id", "chunk_no", "a")
    order = lambda df: sorted((r["job_id"], r["term"], r["n_a"], sorted(tuple(e) for e in r["l_a"])) for r in df.collect())
    assert order(terms) == order(whole[0]) and len(order(terms)) > 10
    assert rows(sums) == rows(whole[1]) and [r[:2] for r in rows(sums)] == [(1, 0), (1, 1), (4, 1), (5, 0)]
    # a line of two rows is one line
    x, d = (1 + math.log(2)) ** 2, math.log(2)
    assert rows(sums)[-1][2:] == pytest.approx((x, x * d, x * d * d))


def test_bullets_are_chosen_in_tasks_of_bounded_size(spark, monkeypatch):
    whole = judging_queries.bullet_choice(spark, SMALL)
    moved = dealt(whole)
    # judgments, wording and pairs of a pair are shuffled once each, and so are the lines of a candidate
    assert not any("ENSURE_REQUIREMENTS" in line and ("req_no" in line or "unit_no" in line) and "cv_id" in line for line in moved) and "u#" not in str(moved)
    monkeypatch.setattr(tailor, "LIST_ROWS", 100, raising=False)
    many = judging_queries.bullet_choice(spark, SMALL)
    assert many.rdd.getNumPartitions() > 12 and rows(many) == rows(whole)


def test_implied_skills_of_a_bullet_count_once(spark):
    made = lambda data, schema: spark.createDataFrame(data, schema)
    units = made([(1, n, f"E{n}", "bullet", f"t{n}", "") for n in (1, 2, 3)], "cv_id long, unit_no int, unit_id string, kind string, text string, context string")
    held = made([(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, None), (1, 3, "c")], "cv_id long, unit_no int, skill string")
    closure = made([("a", "x"), ("a", "b"), ("b", "x"), ("c", None)], "skill string, implied string")
    title = made([(7, "x"), (7, "b"), (7, "c")], "job_id long, skill string")
    none = lambda schema: made([], schema)
    got = tailor.pick_bullets(
        made([(1, 7), (1, 7)], "cv_id long, job_id long"), units, held, none("job_id long, req_no int, kind string, text string, skills array<string>"),
        none("cv_id long, job_id long, req_no int, verdict string, evidence_ids array<string>"), title, title, none("cv_id long, job_id long, unit_no int, skill string"), closure,
    )
    assert rows(got.select("unit_id", "score", "place")) == [("E1", 2.6, 1), ("E3", 1.3, 2)]


def test_mentions_of_a_skill_are_shuffled_once(spark):
    made = [(1, 1, "A", "s1", "k1", False, True, 3), (1, 1, "A", "s2", "k2", True, True, 1), (1, 2, "A", "s3", "k1", False, True, 1), (1, 3, "A", "s1", "k1", True, False, 9), (None, 1, "A", "s", "k", True, True, 1)]
    m = spark.createDataFrame(made, "cv_id long, unit_no int, skill string, surface string, key string, member boolean, weak boolean, pos int")
    units = spark.createDataFrame([(1, 1, "E1", "skills"), (1, 2, "E2", "experience"), (1, 3, "E3", "experience"), (None, 1, "E1", "skills")], "cv_id long, unit_no int, unit_id string, section string")
    index = J.skill_index(m, units)
    assert sum("skill#" in line for line in dealt(index)) == 1
    got = [(r["cv_id"], r["skill"], r["ids"], r["keys"], r["key_ids"], r["weak_only"], r["plain"]) for r in index.collect()]
    assert got == [(1, "A", ["E2", "E3"], ["k1", "k2"], {"k1": ["E2", "E3"], "k2": ["E1"]}, False, "s3")]


def test_literal_evidence_meets_rows_where_they_lie(spark):
    df = judging_queries.skill_verdicts(spark, SMALL)
    # the last joins are by candidate and skill; the pair is no key of them
    assert not any("cv_id" in line and "job_id" in line and "skill" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt(df))


def test_lines_of_a_pair_are_dealt_out_by_what_they_are_joined_on(spark, monkeypatch):
    pairs = spark.range(6).selectExpr("id % 2 AS cv_id", "id AS job_id")
    chunks = spark.range(12).selectExpr("id % 6 AS job_id", "int(id) AS chunk_no", "array('a', 'b', concat('x', id)) AS terms")
    units = spark.range(4).selectExpr("id % 2 AS cv_id", "int(id) AS unit_no", "array('a', concat('x', id)) AS terms")
    key = lambda r: (r["cv_id"], r["job_id"], r["chunk_no"], r["unit_no"], round(r["cosine"], 9))
    whole = sorted(map(key, R.line_cosines(pairs, chunks, units).collect()))
    monkeypatch.setattr(R, "spread_by", lambda df, n, *keys, task_rows=0: df.repartition(9, *keys))
    df = R.line_cosines(pairs, chunks, units)
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in dealt(df)]
    assert not any("cv_id" in x and "job_id" in x and "_no" not in x for x in by) and sorted(map(key, df.collect())) == whole != []
    asked = []
    monkeypatch.setattr(R, "_term_lists", lambda rows, *a: asked.append(plan(rows)) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        R.line_cosines(pairs, chunks, units)
    # the lines are not shuffled to meet the ids of their pairs
    assert "BroadcastHashJoin" in asked[0] and "SortMergeJoin" not in asked[0]


def test_scores_of_a_pool_are_summed_up_where_the_posting_is(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b"]), (3, [])], "job_id long, tokens array<string>")
    asked = spark.createDataFrame([(7, "b", 1), (7, "c", 1), (8, "a", 2)], "cv_id long, token string, weight int")
    df = R.bm25_in_pool(docs, asked, spark.createDataFrame([(7, 1), (7, 2), (8, 1), (8, 3)], "cv_id long, job_id long"))
    assert not any("token" in line and "job_id" in line for line in dealt(df)) and "BroadcastHashJoin [cv_id" in plan(df)
    assert [(c, j, s > 0) for c, j, s in rows(df)] == [(7, 1, True), (7, 2, True), (8, 1, True), (8, 3, False)]
