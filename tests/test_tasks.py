"""Work is dealt out over tasks in proportion to the input, so that what one task holds does not grow with the tables."""
import pytest

from rolewright import cluster
from rolewright.operators import cv as C
from rolewright.operators import lines as N
from rolewright.operators import report
from rolewright.operators import retrieval as R
from rolewright.operators import scoring as S
from rolewright.operators import triage
from rolewright.plans import candidate_queries, report_queries, scoring_queries, tables, text_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def few_rows_a_task(monkeypatch):
    for module in (S, scoring_queries, tables):
        monkeypatch.setattr(module, "spread_by", lambda df, rows, *keys: cluster.spread_by(df, rows, *keys, task_rows=200))


def tasks(spark):
    return -(-tables.line_rows(spark, SMALL) // 200)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_skill_demand_is_counted_in_tasks_of_bounded_size(spark, few_rows_a_task, monkeypatch):
    df = scoring_queries.skill_demand(spark, SMALL)
    assert df.rdd.getNumPartitions() == tasks(spark) > 8
    got = rows(df)
    monkeypatch.undo()
    assert got == rows(scoring_queries.skill_demand(spark, SMALL))


def test_learn_next_is_summed_in_tasks_of_bounded_size(spark, few_rows_a_task, monkeypatch):
    df = scoring_queries.learn_next(spark, SMALL)
    # neither the gaps of a pair, nor its sums, nor the gains of a candidate fall back to the session's partitions
    assert df.rdd.getNumPartitions() == tasks(spark) and "ENSURE_REQUIREMENTS" not in plan(df).replace("SinglePartition, ENSURE_REQUIREMENTS", "")
    got = rows(df)
    monkeypatch.undo()
    assert got == rows(scoring_queries.learn_next(spark, SMALL))


def test_drafts_are_verified_in_tasks_of_bounded_size(spark, few_rows_a_task, monkeypatch):
    df = scoring_queries.tailoring_summary(spark, SMALL)
    assert f", {tasks(spark)}), REPARTITION_BY_NUM" in plan(df)
    # only the counts of a candidate are dealt out once more
    assert all("cv_id" in line for line in plan(df).splitlines() if "hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line)
    got = rows(df)
    monkeypatch.undo()
    assert got == rows(scoring_queries.tailoring_summary(spark, SMALL))


def test_words_are_counted_inside_their_row(spark):
    made = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "job_id long, tokens array<string>")
    counts = R._term_counts(made, spark.createDataFrame([("b",), ("x",)], "token string"))
    assert rows(counts.select("job_id", "token", "tf", "length")) == [(1, "", 1, 3), (1, "b", 2, 3), (2, "", 1, 0)]


def test_bm25_sums_a_pair_up_where_its_document_is(spark, monkeypatch):
    whole = rows(text_queries.bm25_topk(spark, SMALL))
    monkeypatch.setattr(R, "spread_by", lambda df, n, *keys, task_rows: df.repartition(9, *keys))
    df = text_queries.bm25_topk(spark, SMALL)
    assert "hashpartitioning(cv_id#" in plan(df) and not any("hashpartitioning(cv_id#" in line and "job_id" in line for line in plan(df).splitlines())
    assert rows(df) == whole


def test_tfidf_shuffles_the_terms_of_a_document_once(spark, monkeypatch):
    whole = rows(text_queries.tfidf_cosine_topk(spark, SMALL))
    monkeypatch.setattr(R, "spread_by", lambda df, n, *keys, task_rows: df.repartition(9, *keys))
    df = text_queries.tfidf_cosine_topk(spark, SMALL)
    moved = [line for line in plan(df).splitlines() if "hashpartitioning" in line]
    assert len(moved) == 2 and sum("job_id" in line and "REPARTITION_BY_NUM" in line for line in moved) == 1
    assert rows(df) == whole


def test_line_terms_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "LIST_TERMS", 10, raising=False)
    made = spark.range(40).selectExpr("id AS job_id", "0 AS chunk_no", "array('a', 'b', 'b') AS terms")
    terms, sums = R._term_lists(made, "job_id", "chunk_no", "a")
    assert sums.rdd.getNumPartitions() >= 12 and terms.count() == 80 and sums.count() == 40


def test_hybrid_shortlist_deals_out_pairs_and_lines(spark, monkeypatch):
    whole = rows(text_queries.hybrid_shortlist(spark, SMALL))
    dealt = []

    def spread(df, n, *keys, task_rows=0):
        dealt.append(keys)
        return df.repartition(9, *keys)

    for module in (R, triage):
        monkeypatch.setattr(module, "spread_by", spread)
    assert rows(text_queries.hybrid_shortlist(spark, SMALL)) == whole
    assert {("job_id", "skill"), ("cv_id", "job_id"), ("job_id", "term"), ("job_id",)} <= set(dealt)


def test_report_lines_lie_where_the_report_is_put_together(spark, monkeypatch):
    df = report_queries.match_reports(spark, SMALL)
    assert "Exchange" not in plan(df).split("Union")[0]
    whole = rows(df)
    monkeypatch.setattr(report, "TASK_ROWS", 100, raising=False)
    dealt = report_queries.match_reports(spark, SMALL)
    assert dealt.rdd.getNumPartitions() > 12 and rows(dealt) == whole


def test_alignments_search_the_documents_of_a_pair_only(spark, monkeypatch):
    whole = rows(text_queries.term_alignments(spark, SMALL))
    searched, tag = {}, text_queries.M.tag_mentions
    monkeypatch.setattr(text_queries.M, "tag_mentions", lambda lines, keys, *more: searched.update({keys[0]: lines}) or tag(lines, keys, *more))
    assert rows(text_queries.term_alignments(spark, SMALL)) == whole
    asked = {r[0] for r in tables.table(spark, SMALL, "conversations").select("conv_id").collect()}
    assert {r[0] for r in searched["job_id"].select("job_id").collect()} == asked & {r[0] for r in tables.table(spark, SMALL, "documents").select("doc_id").collect()}


def test_lines_of_a_text_are_sorted_once(spark):
    assert plan(C.unit_rows(C.section_rows(candidate_queries.candidate_texts(spark, SMALL)))).count("Sort [") == 1


def test_texts_without_a_hint_of_personal_data_are_not_searched(spark):
    kept = " a@b.org www.x.org/y  +33 (0)6 12 34 56 78 \nat 12, rue de la Paix\n\tJane Ann Doe \n"
    made = spark.createDataFrame([(kept,), ("one two three four five 2021 - 2023",), ("  Ann Bee Cee Dee \nx",), (None,)], "text string")
    out = N.redact(made, "text")
    found = [tuple(r) for r in out.select("text", "n_email", "n_link", "n_phone", "n_address", "n_name").collect()]
    assert found == [
        (" [email] [link]  [phone] \nat [address]\n\t[name] \n", 1, 1, 1, 1, 1), ("one two three four five 2021 - 2023", 0, 0, 0, 0, 0), ("  [name] \nx", 0, 0, 0, 0, 1), (None, None, None, None, None, 0),
    ]
    assert set(N.MAY_HOLD) == {N.EMAIL, N.LINK, N.PHONE, N.ADDRESS}


def test_citations_and_skills_of_a_verdict_stay_in_its_row(spark):
    assert "Generate" not in plan(scoring_queries.evidence_guard(spark, SMALL))
