import json

import samples
from pyspark.sql import functions as F

from rolewright.schemas import posted_timestamp
from rolewright.sources import copied, feeds, files, saved

PAGE = "\n".join(
    ["Skip to main content", "Home", "Rail Co logo", "Rail Co", "Reliability Intern", "Tunis, Tunisia · 2 weeks ago · 37 applicants", "On-site", "Internship",
     "Easy Apply", "Meet the hiring team", "About the job", "Rail Co keeps trains running in the north and in the south of the country.", "- FMEA and Weibull analysis for the whole fleet of trains",
     "See more", "Set alert for similar jobs", "About the company", "Big"]
)


def rows(spark, slug, payload):
    return spark.createDataFrame([(slug, json.dumps(payload))], "slug string, payload string")


def test_five_feeds(spark):
    gh = {"jobs": [{"id": 7, "title": " Eng ", "location": {"name": "Remote, EU"}, "absolute_url": "u", "updated_at": "2024", "content": "&lt;ul&gt;&lt;li&gt;SQL&lt;/li&gt;&lt;/ul&gt;", "departments": [{"name": "D"}]}]}
    r = feeds.normalise_greenhouse(rows(spark, "acme-co", gh).withColumn("board_name", F.lit("ACME"))).first()
    assert (r.job_id, r.company, r.workplace, r.description, r.tags) == ("greenhouse:acme-co:7", "ACME", "remote", "• SQL", ["D"])
    lv = [{"id": "a", "text": "Eng", "categories": {"location": "Paris", "team": "T"}, "workplaceType": "hybrid", "createdAt": 1700000000000, "descriptionPlain": "Hi", "lists": [{"text": "You have", "content": "<li>SQL</li>"}], "additionalPlain": "Bye"}]
    r = feeds.normalise_lever(rows(spark, "acme-co", lv)).first()
    assert r.workplace == "hybrid" and "You have\n• SQL" in r.description and r.company == "Acme Co"
    ash = {"jobs": [{"title": "x", "location": "Tunis", "isListed": True, "isRemote": False, "workplaceType": "OnSite", "descriptionPlain": "d", "jobUrl": "https://a.example/b/c/"}, {"id": "2", "isListed": False}]}
    got = feeds.normalise_ashby(rows(spark, "acme", ash)).collect()
    assert [(g.job_id, g.workplace) for g in got] == [("ashby:acme:c", "onsite")]
    rm = {"jobs": [{"id": 1, "title": "x", "candidate_required_location": "EU", "description": "<p>a</p>", "category": "Data"}]}
    r = feeds.normalise_remotive(rows(spark, "", rm)).first()
    assert (r.location, r.workplace, r.company) == ("Remote (EU)", "remote", "Unknown company") and "Remotive" in r.attribution
    an = {"data": [{"slug": "s", "remote": True, "location": "Berlin", "tags": ["a"], "job_types": ["b"], "created_at": 1700000000}]}
    assert feeds.normalise_arbeitnow(rows(spark, "", an)).first().location == "Berlin (remote)"
    assert feeds.normalise_arbeitnow(rows(spark, "", {"data": []})).count() == 0


def test_board_specs(spark):
    raw = ["stripe", "greenhouse:stripe", "https://jobs.lever.co/acme/", "https://boards.greenhouse.io/embed/job_board?for=zed", "a b"]
    got = [(r.ats, r.slug, r.valid) for r in feeds.parse_board_specs(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()]
    assert got == [(None, "stripe", True), ("greenhouse", "stripe", True), ("lever", "acme", True), ("greenhouse", "zed", True), (None, "a b", False)]


def test_pool_merge_keeps_last_write_and_first_place(spark):
    a = spark.createDataFrame([("x", "old", 1), ("y", "only", 2)], "job_id string, title string, ingest_seq long")
    b = spark.createDataFrame([("x", "new", 3)], "job_id string, title string, ingest_seq long")
    got = {r.job_id: (r.title, r.first_seq) for r in feeds.merge_pool(a, b).collect()}
    assert got == {"x": ("new", 1), "y": ("only", 2)}


def test_copied_page_fields(spark):
    r = copied.extract_copied_pages(spark.createDataFrame([("p", PAGE)], "page_id string, text string")).first()
    assert (r.title, r.company, r.location, r.workplace, r.internship) == ("Reliability Intern", "Rail Co", "Tunis, Tunisia", "onsite", True)
    assert r.description.startswith("Rail Co keeps") and "See more" not in r.description and "About the company" not in r.description


def test_pasted_batch_and_copied_page_in_it(spark):
    text = "Title: Data analyst\nCompany: Acme\nWe need SQL.\n---\n" + PAGE
    got = {r.title: r for r in copied.split_pasted(spark.createDataFrame([(1, text)], "batch_id int, text string")).collect()}
    assert got["Data analyst"].company == "Acme" and got["Data analyst"].description == "We need SQL."
    assert got["Reliability Intern"].company == "Rail Co" and "Skip to main" not in got["Reliability Intern"].description


def test_captures(spark):
    cols = "url string, title string, company string, location string, top string, description string, page_text string, selection string"
    long = "About the job\n" + "word " * 40
    caps = [
        ("https://www.linkedin.com/jobs/view/eng-1234567/", "T", "Co", "Tunis", "On-site Internship", long, "", ""),
        ("", "", "", "", "", "short", PAGE, ""),
        ("", "x", "", "", "", "short", "", ""),
    ]
    ok, bad = copied.captures_to_postings(spark.createDataFrame(caps, cols))
    got = {r.job_id: r for r in ok.collect()}
    assert got["linkedin:1234567"].tags == ["Internship"] and not got["linkedin:1234567"].description.startswith("About the job")
    assert any(r.title == "Reliability Intern" and r.company == "Rail Co" for r in got.values())
    assert [r.title for r in bad.collect()] == ["x"]


def test_saved_set(spark):
    log = [("a", 1, "save", "x"), ("b", 2, "save", "y"), ("a", 3, "save", "z"), ("b", 4, "remove", None), ("c", 5, "save", "w")]
    got = saved.upsert_saved(None, spark.createDataFrame(log, "job_id string, saved_at int, op string, title string"))
    assert [(r.job_id, r.title, r.position) for r in got.orderBy("position").collect()] == [("c", "w", 1), ("a", "z", 2)]


def test_snapshot_labels_and_cv_folder(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"note": "n", "jobs": [{"id": "a:1", "source": "a", "title": "t", "tags": ["x"], "description": "d"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "a:2", "source": "a", "title": "t2"}]))
    first = files.read_snapshot(spark, str(tmp_path / "s.json"))
    assert first.first().job_id == "a:1" and files.read_snapshot(spark, str(tmp_path / "b.json")).first().workplace == "unknown"
    files.write_snapshot(first, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().title == "t"
    (tmp_path / "l.json").write_text(json.dumps({"cvs": {"jane": {"a:1": 2, "zz": 0}}}))
    labels = files.read_labels(spark, str(tmp_path / "l.json"))
    assert sorted((r.cv_id, r.job_id, r.rel) for r in labels.collect()) == [("jane", "a:1", 2), ("jane", "zz", 0)]
    assert [r.job_id for r in files.unknown_labels(labels, first).collect()] == ["zz"]
    (tmp_path / "cvs").mkdir()
    (tmp_path / "cvs" / "jane.txt").write_text(samples.CV_STUDENT)
    assert files.read_cvs(spark, str(tmp_path / "cvs")).first().cv_id == "jane"


def test_posted_at_mixes_text_and_epochs(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("1700000000",), ("1700000000000",), ("soon",)], "p string")
    got = [str(r.t) if r.t else None for r in df.select(posted_timestamp(F.col("p")).alias("t")).collect()]
    assert got[0].startswith("2024-01-02") and got[1] == got[2] and got[3] is None
