"""Sections, evidence units and experience entries of candidate texts, stated literally."""
from pyspark.sql import functions as F

from rolewright.operators import cv as C


def segmented(spark, text, aliases=None):
    return C.segment(spark.createDataFrame([("c", text)], "cv_id string, text string"), aliases).first()


def units(spark, text, aliases=None):
    return [(u.unit_id, u.section, u.text, u.context, u.kind) for u in segmented(spark, text, aliases).units]


def test_work_lines_open_continue_and_close_units(spark):
    text = """Experience
Engineer | Acme | 2019 - 2021
Team lead of maintenance, Beta
Gamma site
• Ran the weekly planning meeting
of the northern plant
short end.
Then wrote a long report about all pumps.
no more here
Analyst | Delta | 2022
- Made dashboards."""
    assert units(spark, text) == [
        ("E1", "experience", "Ran the weekly planning meeting of the northern plant short end.", "Team lead of maintenance, Beta | Gamma site", "bullet"),
        ("E2", "experience", "Then wrote a long report about all pumps. no more here", "Team lead of maintenance, Beta | Gamma site", "bullet"),
        ("E3", "experience", "Made dashboards.", "Analyst | Delta | 2022", "bullet"),
    ]


def test_a_short_line_after_a_closed_unit_is_a_role_line(spark):
    text = "Projects\n• Built a bridge model.\nBridges and others\n• Wrote the notes\nSkills\nSQL"
    assert [u[2:4] for u in units(spark, text)] == [("Built a bridge model.", ""), ("Wrote the notes", "Bridges and others"), ("SQL", "")]


def test_education_entries_split_at_years_and_degrees(spark):
    text = """Education
Master of mechanics
Some school in the north
2018 - 2020 with honours
Bachelor of physics
Other school 2015
Licence 2012 (first)
with a thesis"""
    assert [u[2] for u in units(spark, text)] == [
        "Master of mechanics Some school in the north 2018 - 2020 with honours", "Bachelor of physics Other school 2015", "Licence 2012 (first) — with a thesis",
    ]


def test_inline_headings_are_labels_inside_skills_until_a_plain_heading(spark, aliases):
    text = """Skills: Python, SQL
Tools: SAP,
Excel
Languages: Dutch
Experience: none
Education:
Master 2018
Languages: English, German
French
Languages: Python, SQL
Summary
One. Two. Three."""
    got = [u[1:3] for u in units(spark, text, aliases)]
    assert got == [
        ("skills", "Python, SQL"), ("skills", "Tools: SAP, Excel"), ("skills", "Languages: Dutch"), ("skills", "Experience: none"), ("education", "Master 2018"),
        ("languages", "English, German; French; Languages: Python, SQL"), ("summary", "One. Two. Three."),
    ]


def test_few_units_fall_back_to_long_lines_and_a_summary_counts_by_its_parts(spark):
    assert units(spark, "Jane\nwrites five words right here\nfour words only here\n• a bullet of five words") == [
        ("E1", "other", "writes five words right here", "", "line"), ("E2", "other", "a bullet of five words", "", "line"),
    ]
    long = " ".join(["Sentence with a few words."] * 60)
    assert {u[1] for u in units(spark, f"Summary\n{long}")} == {"summary"}
    assert units(spark, "") == [] and units(spark, None) == []


def test_experience_entries_start_at_role_lines_after_text(spark):
    text = "Experience\nEngineer | A | 2019\nSite lead\n• did this\nAnalyst | B | 2020\n• and that\nEducation\nMaster 2012\nWork experience\n• more\nIntern | C | 2011"
    row = C.segment(spark.createDataFrame([("c", text)], "cv_id string, text string")).select(C.experience_entries(F.col("lines")).alias("e")).first()
    assert row.e == [["Engineer | A | 2019", "Site lead", "• did this"], ["Analyst | B | 2020", "• and that", "• more"], ["Intern | C | 2011"]]


def test_other_columns_stay_and_long_documents_are_cut_whole(spark):
    text = "Experience\n" + "- wrote some code for the team of twelve.\nEngineer | A | 2012 - 2014\n" * 10_000
    df = spark.createDataFrame([("long", text, 7, "x"), ("none", "", 8, "y")], "cv_id string, text string, n int, row string")
    got = {r.cv_id: r for r in C.segment(df).select("cv_id", "n", "row", F.size("units").alias("u"), F.size("lines").alias("l"), F.size(C.experience_entries(F.col("lines"))).alias("e")).collect()}
    assert (got["long"].n, got["long"].row, got["long"].u, got["long"].l, got["long"].e) == (7, "x", 10_000, 20_000, 10_001)
    assert (got["none"].row, got["none"].u, got["none"].l, got["none"].e) == ("y", 0, 0, 0)


def test_quality_gate_names_its_reasons(spark):
    texts = [("a", "x"), ("b", "word " * 43), ("c", ("one two three four five six. \n" * 20))]
    ok, bad = C.quality_gate(C.segment(spark.createDataFrame(texts, "cv_id string, text string")))
    assert [r.cv_id for r in ok.collect()] == ["c"] and {r.cv_id: r.reason for r in bad.collect()} == {"a": "almost no text", "b": "almost no text"}
