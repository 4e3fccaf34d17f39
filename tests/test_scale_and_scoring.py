import math
import random

from pyspark.sql import functions as F

from rolewright import cluster
from rolewright.operators import evaluate as E
from rolewright.operators import judge as J
from rolewright.operators import retrieval as R
from rolewright.operators import scoring as S
from rolewright.operators import tailor as L
from rolewright.operators import triage as G
from rolewright.streaming import jobs


def test_distributed_rank_equals_window_on_a_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", rnd.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(6)
    order = [F.desc("v"), F.asc("id")]
    wide = {(r.k, r.id): r.n for r in cluster.rank_all(df, ["k"], order, "n", window_rows=10).collect()}
    plain = {(r.k, r.id): r.n for r in cluster.rank_all(df, ["k"], order, "n").collect()}
    assert wide == plain and len(wide) == 3000


def test_sliced_join_equals_plain_join(spark):
    a = spark.createDataFrame([("x" if i % 2 else f"t{i % 5}", i) for i in range(400)], "token string, a int")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("t0", 3), ("t9", 4)], "token string, b int")
    left, right, on = cluster.spread_hot_keys(a, b, ["token"], rows_per_slice=30)
    got = sorted((r.token, r.a, r.b) for r in left.join(right, on).collect())
    assert got == sorted((r.token, r.a, r.b) for r in a.join(b, "token").collect())


def test_shared_skills_equals_brute_force(spark):
    rnd = random.Random(5)
    pool = [f"s{i}" for i in range(25)]
    cvs = [(f"c{i}", rnd.sample(pool, rnd.randint(2, 14))) for i in range(30)]
    held = [(f"j{i}", ["s0"] + rnd.sample(pool[1:], rnd.randint(0, 9))) for i in range(60)]
    got = G.shared_skills(spark.createDataFrame(cvs, "cv_id string, skills array<string>"), spark.createDataFrame(held, "job_id string, skills array<string>"))
    expected = {}
    for c, cs in cvs:
        for j, js in held:
            n = len(set(cs) & set(js))
            if n >= (4 if len(cs) >= 12 else 3):
                expected[(c, j)] = n
    rows = got.collect()
    assert {(r.cv_id, r.job_id): r.n_overlap for r in rows} == expected and len(rows) == len(expected)


def test_title_match_tolerates_plurals_and_french(spark):
    q = spark.createDataFrame([("c", 0, "reliability engineer"), ("c", 1, "data analyst")], "cv_id string, pos int, query string")
    jobs_ = [("a", "Ingénieur fiabilité"), ("b", "Senior Data Analysts"), ("d", "Engineer")]
    got = {r.job_id: r.query for r in G.first_title_match(q, spark.createDataFrame(jobs_, "job_id string, title string")).collect()}
    assert got == {"a": "reliability engineer", "b": "data analyst"}


def test_fit_and_learn_next(spark):
    rows = [("c", "j", 1, "must", "missing", ["A"]), ("c", "j", 2, "must", "met", []), ("c", "j", 3, "nice", "partial", ["B"])]
    j = spark.createDataFrame(rows, "cv_id string, job_id string, req_no int, kind string, verdict string, missing_skills array<string>")
    c = S.coverage(j)
    r = c.first()
    assert (r.must_coverage, r.nice_coverage, r.fit) == (0.5, 0.5, 0.5)
    got = {x.skill: x for x in S.learn_next(j, c).collect()}
    assert got["A"].unlocks == 1 and got["A"].must_count == 1 and got["B"].unlocks == 0 and got["A"].fit_gain > got["B"].fit_gain


def test_bm25_pool_matches_a_direct_computation(spark):
    docs = {"a": ["x", "x", "y"], "b": ["y", "z"], "d": ["w"]}
    d = spark.createDataFrame(list(docs.items()), "job_id string, tokens array<string>")
    q = spark.createDataFrame([("c", "x", 1), ("c", "y", 2)], "cv_id string, token string, weight int")
    pairs = spark.createDataFrame([("c", k) for k in docs], "cv_id string, job_id string")
    got = {r.job_id: r.bm25 for r in R.bm25_in_pool(d, q, pairs).collect()}
    mean = 2.0
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    part = lambda f, k, w, n: w * idf(n) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * k / mean))
    assert abs(got["a"] - part(2, 3, 1, 1) - part(1, 3, 2, 2)) < 1e-9 and abs(got["b"] - part(1, 2, 2, 2)) < 1e-9 and got["d"] == 0.0


def test_evidence_guard(spark):
    asked = spark.createDataFrame([("c", "j", 1, "must", ["A"]), ("c", "j", 2, "must", ["B"]), ("c", "j", 3, "nice", ["C"])], "cv_id string, job_id string, req_no int, kind string, skills array<string>")
    verdicts = spark.createDataFrame(
        [("c", "j", 1, "met", ["E9"], "n", None, None), ("c", "j", 2, "met", ["E1 "], "n", "sk", "scikit")],
        "cv_id string, job_id string, req_no int, verdict string, evidence_ids array<string>, note string, cv_term string, jd_term string",
    )
    units = spark.createDataFrame([("c", "E1")], "cv_id string, unit_id string")
    owned = spark.createDataFrame([("c", "B")], "cv_id string, skill string")
    got = {r.req_no: r for r in J.evidence_guard(verdicts, asked, units, owned).collect()}
    assert got[1].verdict == "missing" and got[1].downgraded and got[1].missing_skills == ["A"]
    assert got[2].verdict == "met" and got[2].gap_type == "wording" and got[2].evidence_ids == ["E1"]
    assert got[3].verdict == "missing" and got[3].note == "not judged" and got[3].missing_skills == ["C"]
    assert J.downgrade_totals(J.evidence_guard(verdicts, asked, units, owned)).first().downgraded == 1


def test_verifier(spark, aliases):
    closure = spark.createDataFrame([], "skill string, implied string")
    drafts = [
        (1, "Built AMDEC sheets for 12 pumps", "Built AMDEC (FMEA) sheets for 12 pumps"),
        (2, "Built AMDEC sheets", "Built AMDEC sheets for 30% less"),
        (3, "Built AMDEC sheets", "Built AMDEC sheets with Docker"),
        (4, "Built", "Built " + "very " * 40),
        (5, "Built", " "),
    ]
    got = {r.id: r.problems for r in L.draft_problems(spark.createDataFrame(drafts, "id int, original string, draft string"), ["id"], aliases, closure).collect()}
    assert got[1] == [] and got[2][0].startswith("adds numbers") and "Docker" in got[3][0] and got[4] == ["much longer than the original"] and got[5] == ["empty draft"]


def test_ndcg(spark):
    labels = spark.createDataFrame([("c", "a", 2), ("c", "b", 0), ("c", "d", 1)], "cv_id string, job_id string, rel int")
    ranked = spark.createDataFrame([("c", "b", 3.0), ("c", "a", 2.0), ("c", "d", 1.0)], "cv_id string, job_id string, score double")
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    assert abs(E.ndcg(ranked, labels).first().ndcg - dcg / (3 + 1 / math.log2(3))) < 1e-12


def test_stream_keeps_the_latest_version(spark, tmp_path):
    land = tmp_path / "land"
    schema = "job_id string, title string, landed_at timestamp"
    spark.sql("SELECT 'a' job_id, 'old' title, TIMESTAMP '2024-01-01 00:00:00' landed_at UNION ALL SELECT 'b', 'x', TIMESTAMP '2024-01-01 00:01:00'").write.json(str(land))
    go = lambda: jobs.finish(jobs.start_ingest(jobs.read_landing(spark, str(land), schema), lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")))
    go()
    spark.sql("SELECT 'a' job_id, 'new' title, TIMESTAMP '2024-01-01 01:00:00' landed_at").write.mode("append").json(str(land))
    go()
    assert {r.job_id: r.title for r in jobs.current_postings(spark, str(tmp_path / "out")).collect()} == {"a": "new", "b": "x"}
