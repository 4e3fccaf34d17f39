"""Cases of reviewers: ties by rounding noise, ids that collide, versions that return."""
import math
import random
from datetime import datetime

from rolewright.cluster import spread_by
from rolewright.operators import judge as J
from rolewright.operators import lines as N
from rolewright.operators import mentions as M
from rolewright.operators import retrieval as R
from rolewright.operators import tailor as L
from rolewright.plans import shortlist_queries
from rolewright.sources import copied
from rolewright.streaming import jobs


def test_equally_close_lines_are_cited_by_their_place(spark):
    rnd = random.Random(5)
    vectors = [[rnd.uniform(-1, 1) for _ in range(7)] for _ in range(200)]
    asked = [[rnd.uniform(-1, 1) for _ in range(7)] for _ in vectors]
    asked = [q if sum(a * b for a, b in zip(q, v)) > 0 else [-a for a in q] for q, v in zip(asked, vectors)]
    pairs = spark.createDataFrame([(i, i) for i in range(200)], "cv_id long, job_id long")
    units = spark.createDataFrame([(i, n, f"E{n}", "experience") for i in range(200) for n in (0, 1)], "cv_id long, unit_no int, unit_id string, section string")
    held = spark.createDataFrame([(i, n, [x * (1, 3)[n] for x in v]) for i, v in enumerate(vectors) for n in (0, 1)], "cv_id long, unit_no int, vec array<double>")
    reqs = spark.createDataFrame([(i, 1, q) for i, q in enumerate(asked)], "job_id long, req_no int, vec array<double>")
    got = J.closest_by_vector(pairs, reqs, units, reqs, held).collect()
    assert len(got) == 200 and {r.unit_id for r in got} == {"E0"}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert all(abs(r.score - cosine(vectors[r.cv_id], asked[r.cv_id])) < 1e-12 for r in got)


def test_pasted_postings_whose_digests_begin_alike_stay_apart(spark):
    got = copied.split_pasted(spark.createDataFrame([(1, "Role 727598\n---\nRole 2061504")], "batch_id int, text string")).collect()
    assert len({r.job_id for r in got}) == 2


def test_a_posting_that_goes_back_to_an_earlier_content_is_a_new_version(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    schema = "job_id string, title string, landed_at timestamp"
    at = lambda h: datetime(2024, 1, 1, h)
    for rows in ([("j", "one", at(1)), ("k", "same", at(1))], [("j", "two", at(2)), ("j", "one", at(1))], [("j", "one", at(3)), ("k", "same", at(4))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        jobs.finish(jobs.start_ingest(jobs.read_landing(spark, folder, schema, max_files=1), lambda b: b, out, state))
    assert {(r.job_id, r.title, r.landed_at.hour) for r in jobs.current_postings(spark, out).collect()} == {("j", "one", 3), ("k", "same", 4)}


def test_bullets_are_chosen_within_one_row_a_pair(spark):
    make = spark.createDataFrame
    pairs = make([("c", "j"), ("c", "k")], "cv_id string, job_id string")
    units = make([("c", n, f"E{n}", "skills" if n == 4 else "bullet", f"line {n}", "") for n in range(1, 5)], "cv_id string, unit_no int, unit_id string, kind string, text string, context string")
    held = make([("c", 1, "a"), ("c", 2, "b"), ("c", 3, "a"), ("c", 3, "b"), ("c", 4, "a")], "cv_id string, unit_no int, skill string")
    reqs = make([("j", 1, "must", "one", ["a"]), ("j", 2, "nice", "two", ["x"])], "job_id string, req_no int, kind string, text string, skills array<string>")
    judged = make([("c", "j", 1, "met", []), ("c", "j", 2, "partial", ["E2", "E4"])], "cv_id string, job_id string, req_no int, verdict string, evidence_ids array<string>")
    terms, title = make([("j", "b"), ("k", "b")], "job_id string, skill string"), make([("j", "z")], "job_id string, skill string")
    worded = make([("c", "k", 4)] * 3, "cv_id string, job_id string, unit_no int")
    closure = make([("b", "z")], "skill string, implied string")
    got = L.pick_bullets(pairs, units, held, reqs, judged, terms, title, worded, closure, n=2)
    rows = {(r.job_id, r.place, r.unit_id, r.original, r.score, tuple(r.targets)) for r in got.collect()}
    # E4 is no bullet, so the points for its wording take no bullet's place
    assert rows == {("j", 1, "E1", "line 1", 2.0, ("one",)), ("j", 2, "E3", "line 3", 3.3, ("one",)), ("k", 1, "E2", "line 2", 0.3, ()), ("k", 2, "E3", "line 3", 0.3, ())}
    assert not [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "skill" in line and "job_id" in line]


def test_hits_that_reach_into_each_other_and_hits_that_do_not(spark):
    row = lambda line, pos, stop, match, skill, chars: (line, pos, stop, match, skill, skill, False, False, False, chars)
    rows = [row(1, p, p + 1, "ci", f"s{p % 3}", 4) for p in range(1, 400)] + [row(2, 1, 3, "ci", "long", 9), row(2, 2, 3, "ci", "inner", 4), row(2, 2, 3, "list", "R", 1), row(2, 3, 4, "ci", "next", 4)]
    rows += [row(3, 1, 2, "ci", "one", 3), row(3, 1, 2, "ci", "two", 3), row(3, 1, 3, "exact", "one", 5)]
    schema = "line int, pos int, stop int, match string, skill string, surface string, french boolean, member boolean, weak boolean, chars int"
    found = M.resolve_hits(spark.createDataFrame(rows, schema), ["line"])
    got = {(r.line, r.pos, r.skill, r.match) for r in found.collect()}
    assert {g for g in got if g[0] > 1} == {(2, 1, "long", "ci"), (2, 2, "R", "list"), (2, 3, "next", "ci"), (3, 1, "one", "exact"), (3, 1, "two", "ci")}
    assert len([g for g in got if g[0] == 1]) == 399
    # a line without crossing hits is kept without the quadratic fold
    assert "CASE WHEN exists" in found._jdf.queryExecution().optimizedPlan().toString()


def test_line_terms_are_counted_without_a_shuffle_of_terms(spark, tmp_path):
    texts = ["one two\n\n - three three\nfour", "", None, "a b c d e f g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = shortlist_queries.line_terms(spark, str(tmp_path))
    lines = N.to_lines(spark.createDataFrame(list(enumerate(texts)), "job_id long, text string"), ["job_id"], "text")
    flat = {(r.job_id, t) for r in lines.select("job_id", R.line_terms(lines.text).alias("t")).collect() for t in r.t}
    got = {(r.job_id, r.kind): (r.n_terms, r.n_distinct, r.first) for r in df.collect()}
    assert got[0, "skill"] == (6, 1, "sk:0") and got[0, "pair"] == (2, 2, "one_two") and got[0, "gram"] == (5, 3, "#four") and (1, "skill") not in got and (2, "skill") not in got
    assert sum(d for (_, kind), (_, d, _) in got.items() if kind != "skill") == len(flat)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_only_asked_terms_keep_their_lists_and_all_count_for_the_norms(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b", "b"]), (1, 2, ["b", "c"]), (2, 1, ["c"])], "job_id long, chunk_no int, terms array<string>")
    whole, sums = R._term_lists(rows, "job_id", "chunk_no", "a")
    few, same = R._term_lists(rows, "job_id", "chunk_no", "a", spark.createDataFrame([("c",)], "term string"))
    assert {(r.job_id, r.term, len(r.l_a), r.n_a) for r in whole.collect()} == {(1, "a", 1, 2), (1, "b", 2, 2), (1, "c", 1, 2), (2, "c", 1, 1)}
    assert {(r.job_id, r.term) for r in few.collect()} == {(1, "c"), (2, "c")}
    shown = lambda df: sorted((r.job_id, r.chunk_no, round(r.s0, 9), round(r.s1, 9), round(r.s2, 9)) for r in df.collect())
    assert shown(sums) == shown(same) and len(shown(sums)) == 3


def test_tasks_are_in_proportion_to_rows(spark):
    rows = spark.range(1000)
    assert spread_by(rows, 1000, "id", task_rows=10).rdd.getNumPartitions() == 100
    assert spread_by(rows, 1000, "id", task_rows=500).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
