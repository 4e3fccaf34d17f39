from datetime import date

import samples
from pyspark.sql import functions as F

from rolewright.operators import cv as C
from rolewright.operators import report as R
from rolewright.schemas import POSTING


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_units_are_verbatim_and_wrapped_lines_joined(run):
    u = {(r.cv_id, r.unit_id): r for r in run.units.collect()}
    e2 = u[("student", "E2")]
    assert e2.text == "Participated in AMDEC workshops (12 pumps) and wrote the minutes with the team"
    assert e2.context == "Maintenance Intern | Acme Rail | Feb 2024 - Jul 2024" and e2.kind == "bullet"
    assert u[("student", "E5")].text == "Programming: Python, R, SQL, pandas" and u[("student", "E6")].section == "skills"
    assert sum(1 for k, r in u.items() if k[0] == "student" and r.kind == "bullet") == 3


def test_profiles(run):
    p = by(run.profiles, "cv_id")
    s, b = p["student"], p["backend"]
    assert (s.seniority, s.years_experience, s.internship_months, s.location) == ("student", 0.0, 9, "Tunis")
    assert (b.seniority, b.years_experience) == ("mid", 3.2) and b.languages == {"German": 5, "English": 3}
    assert s.languages == {"English": 4, "French": 5} and s.target_titles[0] == "reliability engineer"
    assert "[name]" not in s.headline and s.headline == "Reliability Engineering Student"


def test_date_ranges(spark):
    t = "jan 2020 - mar 2021; 2021 - 2023; fevrier 2022 a aujourd'hui; 03/2019 - 05/2019"
    r = spark.createDataFrame([(t,)], "t string").select(C.date_ranges(F.col("t"), date(2024, 6, 1)).alias("x")).first().x
    assert [(x.a, x.b) for x in r] == [(24240, 24255), (24258, 24282), (24265, 24294), (24230, 24233)]


def test_search_was_widened_and_triage_gives_reasons(run):
    s = by(run.search, "cv_id")
    assert s["student"]["round"] == 2 and len(s["student"].queries) <= 12
    t = by(run.triaged, "cv_id", "job_id")
    assert t[("student", "j:rel")].reason == "title matches 'reliability engineer'" and ("student", "j:cook") not in t


def test_requirements(run):
    r = by(run.requirements, "job_id", "req_no")
    assert r[("j:rel", 1)].min_years == 1.0 and r[("j:rel", 1)].category == "experience"
    assert r[("j:rel", 4)].languages == ["French"] and r[("j:rel", 5)].category == "education"
    assert r[("j:rel", 6)].kind == "nice" and not any("Team player" in x.text for x in r.values())


def test_judgments(run):
    j = by(run.judgments, "cv_id", "job_id", "req_no")
    two = j[("student", "j:rel", 2)]
    assert (two.verdict, two.gap_type, two.cv_term, two.jd_term) == ("met", "wording", "AMDEC", "FMEA") and "CMMS implied by SAP PM" in two.note
    assert j[("student", "j:rel", 3)].verdict == "met"
    dax = j[("student", "j:rel", 6)]
    assert dax.verdict == "partial" and dax.note == "has Power BI, not DAX" and dax.missing_skills == ["DAX"]
    assert j[("student", "j:rel", 7)].missing_skills == ["Weibull analysis"]
    assert all(x.evidence_ids for x in j.values() if x.verdict != "missing")


def test_ranking_learning_and_flags(run):
    r = by(run.ranked, "cv_id", "job_id")
    assert r[("student", "j:rel")].fit == 0.7375 and r[("backend", "j:back")].fit == 0.75
    learn = by(run.learn, "cv_id", "skill")
    assert learn[("backend", "TensorFlow")].unlocks == 1 and learn[("backend", "TensorFlow")].fit_gain == 0.25
    assert learn[("student", "DAX")].unlocks == 0
    assert [f.message for f in run.flags.collect()] == ["Remote, but limited to Remote (US only)"]


def test_tailoring_rejects_invented_skills(run):
    t = by(run.tailored, "cv_id", "job_id", "unit_no")
    b = t[("student", "j:rel", 2)]
    assert b.status == "verified" and b.attempts == 2 and b.off_violation
    assert b.final == "Contributed to AMDEC (FMEA) workshops (12 pumps) and wrote the minutes with the team"


def test_report_covers_every_stage(run):
    text = by(run.reports, "cv_id")["student"].markdown
    for part in ("## Profile", "## Ranked jobs", "you write “AMDEC”, they write “FMEA”", "## Learn next", "## Tailored bullets", "Rejected draft", "## Sources"):
        assert part in text
    assert samples.JOB_COOK.split()[0] not in text


def test_report_folders_and_a_candidate_without_postings(spark, run, tmp_path):
    R.write_reports(run.reports, str(tmp_path / "reports"), folders=True)
    back = {r.cv_id: r.value for r in spark.read.text(str(tmp_path / "reports"), wholetext=True).collect()}
    assert {k: v.removesuffix("\n") for k, v in back.items()} == {r.cv_id: r.markdown.removesuffix("\n") for r in run.reports.collect()}
    frames = [run.ranked, spark.createDataFrame(samples.posting_rows(), POSTING), run.requirements, run.judgments, run.units, run.flags, run.learn, run.tailored]
    tries = spark.createDataFrame([], "cv_id string, job_id string, unit_no int, attempt int, draft string, problems array<string>")
    bare = {r.cv_id: r.markdown for r in R.match_report(run.profiles, *(f.limit(0) for f in frames), tries).collect()}
    assert set(bare) == set(back) and all("## Profile" in t and t.count("## ") == 1 for t in bare.values())
    assert R.match_report(run.profiles.limit(0), *frames, tries).count() == 0
    short = {r.cv_id: r.markdown for r in R.match_report(run.profiles, *frames, tries, top_skills=1, quote_chars=5).collect()}
    assert "“Partic”" not in short["student"] and "“Parti”" in short["student"]
