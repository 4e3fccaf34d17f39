"""Literal evidence, study fields, vectors, whole-pool shortlists, snapshots, merged profiles."""
import math
import random

import pytest
from pyspark.sql import functions as F

from rolewright import cluster
from rolewright.functions import text as T
from rolewright.operators import cv as C
from rolewright.operators import judge as J
from rolewright.operators import retrieval as R
from rolewright.operators import triage as G
from rolewright.sources import files


def test_terms_are_found_by_their_rarest_word_and_as_whole_words(spark):
    units = [("c", i, f"E{i}", f"the line {i}") for i in range(1, 30)] + [("c", 30, "E30", "Ran The Zeppelin-Dock"), ("c", 31, "E31", "the zeppelin dock (C++)"), ("d", 1, "E1", "the zeppelins")]
    terms = [("j", "the zeppelin"), ("j", "Zeppelin-dock"), ("j", "c++"), ("k", "the zeppelin"), ("k", "zep"), ("k", "++")]
    pairs = spark.createDataFrame([("c", "j"), ("c", "k"), ("d", "j"), ("c", "j")], "cv_id string, job_id string")
    got = J.literal_evidence(pairs, spark.createDataFrame(terms, "job_id string, skill string"), spark.createDataFrame(units, "cv_id string, unit_no int, unit_id string, text string"))
    assert sorted(map(tuple, got.collect())) == [("c", "j", "Zeppelin-dock", "E30"), ("c", "j", "c++", "E31"), ("c", "j", "the zeppelin", "E30"), ("c", "k", "the zeppelin", "E30")]


def test_education_is_the_worst_of_its_parts(spark):
    reqs = spark.createDataFrame([("j", 1, "Student in mechanical engineering"), ("j", 2, "Engineering degree"), ("j", 3, "A diploma"), ("k", 1, "Physics or astro")], "job_id string, req_no int, text string")
    edu = [("a", 4, "E4", "Bac"), ("a", 5, "E5", "Electromechanical college"), ("b", 1, "E1", "Engineer"), ("d", 2, "E2", "astro school")]
    people = spark.createDataFrame([("a", "student"), ("b", "mid"), ("c", "mid"), ("d", None)], "cv_id string, seniority string")
    pairs = spark.createDataFrame([(c, "j") for c in "abc"] + [("d", "k")], "cv_id string, job_id string")
    fields = J.study_field_table(spark).unionByName(spark.createDataFrame([("space", "Astro")], "concept string, word string"))
    got = J.education_judgments(pairs, reqs, spark.createDataFrame(edu, "cv_id string, unit_no int, unit_id string, text string"), people, fields)
    assert {(r.cv_id, r.job_id, r.req_no): (r.verdict, r.unit_id, r.note) for r in got.collect()} == {
        ("a", "j", 1): ("met", "E5", "student"), ("a", "j", 2): ("partial", "E4", ""), ("a", "j", 3): ("met", "E4", ""),
        ("b", "j", 1): ("partial", "E1", "asks for a student; different field of study"), ("b", "j", 2): ("met", "E1", ""), ("b", "j", 3): ("met", "E1", ""),
        ("c", "j", 1): ("missing", None, "no education section found"), ("c", "j", 2): ("missing", None, "no education section found"), ("c", "j", 3): ("missing", None, "no education section found"),
        ("d", "k", 1): ("met", "E2", ""),
    }


@pytest.mark.parametrize("block", [1, 3, 50])
def test_closest_vectors_equal_brute_force_for_every_block_size(spark, block):
    draw = random.Random(block)
    vec = lambda: [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]
    reqs = {(j, r): vec() for j in "xy" for r in range(1, 5)}
    lines = {(c, u): vec() for c in "ab" for u in range(1, 8)}
    units = [(c, u, f"E{u}", "languages" if u == 7 else "projects") for c, u in lines] + [("a", 9, "E9", "projects")]
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    expected = {}
    for c in "ab":
        for (j, r), v in reqs.items():
            scored = [(sum(p * q for p, q in zip(unit(v), unit(w))), -u) for (o, u), w in lines.items() if o == c and u < 7] + ([(0.0, -9)] if c == "a" else [])
            best = max(round(s, 9) for s, _ in scored)
            expected[c, j, r] = (best, min(-u for s, u in scored if round(s, 9) == best))
    pairs = spark.createDataFrame([(c, j) for c in "ab" for j in "xy"], "cv_id string, job_id string")
    rv = spark.createDataFrame([(*k, v) for k, v in reqs.items()], "job_id string, req_no int, vec array<double>")
    uv = spark.createDataFrame([(*k, v) for k, v in lines.items()], "cv_id string, unit_no int, vec array<double>")
    got = J.closest_by_vector(pairs, rv, spark.createDataFrame(units, "cv_id string, unit_no int, unit_id string, section string"), rv, uv, block)
    assert {(r.cv_id, r.job_id, r.req_no): (round(r.score, 9), r.unit_no) for r in got.collect()} == expected


def test_first_absent_places_and_running_sums_of_any_group_size(spark):
    draw = random.Random(8)
    held = {o: sorted(draw.sample(range(1, 60), n)) for o, n in (("a", 0), ("b", 5), ("c", 40), ("d", 59))}
    rows = spark.createDataFrame([(o, s, s % 2) for o, ss in held.items() for s in ss], "o string, seq long, odd int")
    for window_rows in (1000, 3):
        x = cluster.running_sums(rows, ["o"], [F.col("seq")], {"rank": F.lit(1), "odds": F.col("odd")}, window_rows)
        assert sorted((r.o, r.seq, r.rank, r.odds) for r in x.collect()) == sorted((o, s, i + 1, sum(t % 2 for t in ss[: i + 1])) for o, ss in held.items() for i, s in enumerate(ss))
        got = cluster.first_absent(spark.createDataFrame([(o,) for o in held], "o string"), x, "o", 4, ["odd"]).collect()
        free = {o: [s for s in range(1, 100) if s not in ss][:4] for o, ss in held.items()}
        assert sorted((r.o, r.nth, r.seq, r.odd) for r in got) == sorted((o, i + 1, s, sum(t % 2 for t in held[o] if t < s)) for o, ss in free.items() for i, s in enumerate(ss))


def _ranked(scores, jobs, k):
    by = lambda n: {j: i + 1 for i, j in enumerate(sorted(jobs, key=lambda j: (-scores[j][n], j)))}
    one, two = by(0), by(1)
    return sorted(jobs, key=lambda j: (-(1 / (60 + one[j]) + 1 / (60 + two[j])), j))[:k]


def test_pool_shortlist_equals_a_full_ranking(spark):
    draw = random.Random(12)
    words = [f"{a}{b}" for a in ("plan", "weld", "code", "cook", "test") for b in ("ing", "er", "s", "able")]
    jobs = {f"j{i:02d}": " ".join(draw.choice(words) for _ in range(draw.randrange(1, 6))) for i in range(40)}
    cvs = {"a": "planer welds", "b": "xyz", "c": "", "d": " ".join(words)}
    docs = spark.createDataFrame(list(jobs.items()), "job_id string, text string")
    mine = spark.createDataFrame(list(cvs.items()), "cv_id string, text string")
    chunks = docs.select("job_id", F.lit(0).alias("chunk_no"), R.line_terms(F.col("text")).alias("terms"))
    units = mine.where("text <> ''").select("cv_id", F.lit(1).alias("unit_no"), R.line_terms(F.col("text")).alias("terms"))
    tokens = docs.select("job_id", T.tokens(F.col("text")).alias("tokens"))
    every = mine.select("cv_id").crossJoin(docs.select("job_id"))
    bm = {(r.cv_id, r.job_id): r.bm25 for r in R.bm25(tokens, R.query_terms(mine)).collect()}
    sem = {(r.cv_id, r.job_id): r.semantic for r in R.maxsim(every, chunks, R.line_cosines(every, chunks, units)).collect()}
    got = {}
    for r in R.pool_shortlist(mine, tokens, R.query_terms(mine), chunks, units, 7, digits=9).orderBy("place").collect():
        got.setdefault(r.cv_id, []).append(r.job_id)
    for c in cvs:
        assert got[c] == _ranked({j: (round(bm.get((c, j), 0), 9), round(sem.get((c, j), 0), 9)) for j in jobs}, jobs, 7)
    assert got["b"] == got["c"] == sorted(jobs)[:7]
    assert R.pool_shortlist(mine.limit(0), tokens, R.query_terms(mine), chunks, units).count() == 0


def test_line_cosines_equal_the_direct_formula(spark):
    draw = random.Random(3)
    chunks = [("j", c, [draw.choice("abcdef") for _ in range(draw.randrange(0, 9))]) for c in range(4)]
    units = [("x", u, [draw.choice("abcxyz") for _ in range(draw.randrange(1, 7))]) for u in range(3)]
    pairs = spark.createDataFrame([("x", "j")], "cv_id string, job_id string")
    got = R.line_cosines(pairs, spark.createDataFrame(chunks, "job_id string, chunk_no int, terms array<string>"), spark.createDataFrame(units, "cv_id string, unit_no int, terms array<string>"))
    lines = [t for *_, t in chunks + units]
    idf = lambda t: math.log((1 + len(lines)) / (1 + sum(t in x for x in lines))) + 1
    vec = lambda ts: {t: (1 + math.log(ts.count(t))) * idf(t) for t in set(ts)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = {}
    for _, c, ct in chunks:
        for _, u, ut in units:
            a, b = vec(ct), vec(ut)
            if set(a) & set(b):
                expected[c, u] = sum(a[t] * b[t] for t in set(a) & set(b)) / norm(a) / norm(b)
    assert {(r.chunk_no, r.unit_no): r.cosine for r in got.collect()} == {k: pytest.approx(v) for k, v in expected.items()}


def test_candidates_without_match_get_postings_of_the_whole_pool(run):
    assert {r.cv_id for r in run.shortlist.collect()} >= {"student", "backend"}
    assert G.candidates_without_match(run.profiles, run.triaged).count() == 0


def test_snapshot_sources_replace_themselves_and_prune(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(i, s, t) for i, s, t in xs], "job_id string, source string, title string")
    path = str(tmp_path / "snapshot")
    files.write_snapshot(rows(("a:1", "a", "old"), ("b:1", "b", "b"), ("a:2", "a", "gone")), path)
    files.write_snapshot(rows(("a:1", "a", "new")), path)
    assert {(r.job_id, r.title) for r in files.read_posting_table(spark, path).collect()} == {("a:1", "new"), ("b:1", "b")}
    one = files.read_posting_table(spark, path, ["b"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.job_id for r in one.collect()] == ["b:1"] and "PartitionFilters: [source" in plan.replace("isnotnull(source#", "source#")[:100000] or "PartitionFilters" in plan and "source" in plan.split("PartitionFilters")[1][:120]


def test_merge_takes_the_higher_level_of_a_language_listed_twice(spark):
    base = spark.createDataFrame(
        [("a", "h", ["t"], ["Python"], ["d"], 0.0, 0, "mid", {"French": 2}, ["e"], "", "en", "rules")],
        "cv_id string, headline string, target_titles array<string>, skills array<string>, domains array<string>, years_experience double, internship_months int, seniority string, "
        "languages map<string,int>, education array<string>, location string, cv_language string, source string",
    )
    base = base.withColumn("family_scores", C.family_scores(F.col("skills"), F.lit("")))
    extra = spark.createDataFrame(
        [("a", None, None, ["SQL", "SQL", " "], None, 4.0, "senior", [("French", "basic"), ("Deutsch", "fluent"), ("german", "native")], "Rome")],
        "cv_id string, headline string, target_titles array<string>, skills array<string>, domains array<string>, years_experience double, seniority string, languages array<struct<name:string,level:string>>, location string",
    )
    r = C.merge_profiles(base, extra).first()
    assert (r.headline, r.target_titles, r.skills, r.domains, r.years_experience, r.seniority, r.location) == ("h", ["t"], ["Python", "SQL"], ["d"], 4.0, "senior", "Rome")
    assert r.languages == {"French": 2, "German": 5}
    assert sum(f.score for f in r.family_scores) > sum(f.score for f in base.first().family_scores)
