"""Requirements and facts of every posting. The DuckDB counterparts state the cue words that occur here, literally."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut_lineage
from ..operators import postings as P
from .tables import benchmark_aliases, fold_sql, lines_sql, lit, mentions_sql, texts, vocabulary_sql

#: Lines put into documents by their number modulo the length of the list: among the musts, and at the end of the nice-to-haves.
_MUSTS = (
    "3+ years of SQL", "At least 5 to 7 years in plants", "Fluent French and good English", "Bachelor's degree or final-year student", "Team player", "ok",
    "Certified welder (a plus)", "It is a plus: 2 ans",
)
_NICES = ("3+ years of SQL", "Ideally German", "Motivated and curious", "Salary range 5", "Python or so")
_TITLES = ("Senior role", "Role", "Internship role", "Lead role", "Junior role", "Expert role")
_MIN_CHARS = 8


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is a must, the others are nice to have."""
    d, k = texts(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    head, rest = F.regexp_extract("text", r"^([^\n]*)", 1), F.regexp_replace("text", r"^[^\n]*\n?", "")
    body = F.concat(F.lit("Intro words.\nRequirements:\n"), head, F.lit("\n"), pick(_MUSTS), F.lit("\nNICE TO HAVE\n"), rest, F.lit("\n"), pick(_NICES), F.lit("\nWhat we offer\nLunch"))
    feed = F.when(k % 7 == 0, "linkedin").otherwise("lever")
    tags = F.when(k % 14 == 0, F.array(F.lit("Internship"))).otherwise(F.array().cast("array<string>"))
    return d.select(k.cast("string").alias("job_id"), feed.alias("source"), pick(_TITLES).alias("title"), body.alias("description"), F.lit("onsite").alias("workplace"), tags.alias("tags"))


def _requirements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    postings = _postings(spark, sf_dir)
    return postings, cut_lineage(P.extract_requirements(postings, cut_lineage(benchmark_aliases(spark, sf_dir, _MIN_CHARS))))


def posting_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement of every posting: text, kind, category, skills in order, years, languages."""
    _, found = _requirements(spark, sf_dir)
    return found.select("job_id", "req_no", "text", "kind", "category", F.array_join("skills", ",").alias("skills"), F.coalesce("min_years", F.lit(-1.0)).alias("min_years"), F.array_join("languages", ",").alias("languages"))


def posting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of every posting: counts, years, languages, seniority, language of its text."""
    postings, found = _requirements(spark, sf_dir)
    facts = P.posting_facts(postings, found)
    return facts.withColumns({"languages": F.array_join("languages", ","), "min_years": F.coalesce("min_years", F.lit(-1.0))})


QUERIES = {f.__name__: f for f in (posting_requirements, posting_facts)}


def _values(rows: tuple[str, ...]) -> str:
    return f"[{', '.join(lit(r) for r in rows)}][doc_id % {len(rows)} + 1]"


def _words_sql(words: str) -> str:
    listed = ", ".join(lit(w) for w in words.split())
    return f"len(list_filter(ws, lambda w: w IN ({listed})))"


_REQUIREMENTS_SQL = rf"""
{vocabulary_sql(_MIN_CHARS).strip()},
src AS ({lines_sql('documents', 'doc_id', 'text')}),
every_line AS (
  SELECT doc_id, line_no::DOUBLE AS ln, CASE WHEN line_no = 1 THEN 'must' ELSE 'nice' END AS section, text FROM src
  UNION ALL SELECT doc_id, 1.5, 'must', {_values(_MUSTS)} FROM documents UNION ALL SELECT doc_id, 1e9, 'nice', {_values(_NICES)} FROM documents),
plain AS (SELECT *, {fold_sql('text')} AS f FROM every_line WHERE NOT contains({fold_sql('text')}, 'salary range')),
kinds AS (SELECT doc_id, ln, text, f, CASE WHEN regexp_matches(regexp_replace(f, '\([^)]*\)', ' ', 'g'), '\b(a plus|ideally|bonus|preferred)\b') THEN 'nice' ELSE section END AS kind FROM plain),
{mentions_sql('ment', 'kinds', 'doc_id, ln', 'text').strip()},
sk AS (SELECT doc_id, ln, string_agg(skill, ',' ORDER BY pos) AS skills, count(*) AS n FROM (SELECT doc_id, ln, skill, min(pos) AS pos FROM ment GROUP BY ALL) GROUP BY ALL),
facts AS (
  SELECT kinds.*, coalesce(skills, '') AS skills, coalesce(n, 0) AS n, try_cast(regexp_extract(f, '([0-9]{{1,2}})\s*\+?\s*((-|to|a|bis)\s*[0-9]{{1,2}}\s*)?(years?|yrs|ans|annees|jahre)', 1) AS DOUBLE) AS years,
         list_transform(regexp_extract_all(f, '\b(french|english|german)\b'), lambda w: upper(left(w, 1)) || substr(w, 2)) AS named,
         regexp_matches(f, '\b(fluent|fluency|speak|spoken|written|native|language|level|c1|c2|b2)\b') OR len(regexp_extract_all(text, '\S+')) <= 6 AS asks,
         regexp_matches(f, '\b(degree|bachelor''?s?|master''?s?|phd|licence|graduated|student|final[- ]year)\b') AS degree, regexp_matches(f, '\b(team player|motivated|curious|communicat|autonom|passion)') AS soft
  FROM kinds LEFT JOIN sk USING (doc_id, ln)),
long AS (SELECT *, CASE WHEN asks THEN named ELSE [] END AS langs FROM facts WHERE NOT (length(text) < 3 OR (length(text) < 8 AND n = 0 AND len(named) = 0))),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(f, '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g')) ORDER BY ln) AS i FROM long),
req AS (
  SELECT *, CASE WHEN years IS NOT NULL THEN 'experience' WHEN n = 0 AND len(langs) > 0 THEN 'language' WHEN n = 0 AND degree THEN 'education' WHEN n = 0 AND contains(f, 'certif') THEN 'certification' WHEN n > 0 THEN 'skill' ELSE 'domain' END AS category,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln)::INTEGER AS req_no
  FROM once WHERE i = 1 AND NOT (n = 0 AND len(langs) = 0 AND years IS NULL AND NOT degree AND soft))"""

ORACLES = {
    "posting_requirements": f"""WITH {_REQUIREMENTS_SQL}
      SELECT doc_id::VARCHAR AS job_id, req_no, text, kind, category, skills, coalesce(years, -1.0::DOUBLE) AS min_years, array_to_string(langs, ',') AS languages FROM req""",
    "posting_facts": f"""WITH {_REQUIREMENTS_SQL},
      per AS (SELECT doc_id, count(*) FILTER (kind = 'must') AS n_must, count(*) FILTER (kind = 'nice') AS n_nice, max(years) FILTER (kind = 'must') AS y, array_to_string(list_sort(list_distinct(flatten(list(langs)))), ',') AS languages FROM req GROUP BY doc_id),
      t AS (SELECT doc_id, {_values(_TITLES)} AS title, regexp_extract_all({fold_sql(f"'Intro words. Requirements: ' || text || ' ' || {_values(_MUSTS)} || ' NICE TO HAVE ' || {_values(_NICES)} || ' What we offer Lunch'")}, '[a-z]+') AS ws FROM documents),
      w AS (SELECT doc_id, title, {_words_sql('the and with you will for our experience team of')} AS en, {_words_sql('le la les et des avec vous pour une nous experience equipe')} AS fr, {_words_sql('und der die das mit sie fur wir ihre erfahrung du dein')} AS de FROM t)
      SELECT w.doc_id::VARCHAR AS job_id, coalesce(n_must, 0) AS n_must, coalesce(n_nice, 0) AS n_nice, coalesce(y, -1.0::DOUBLE) AS min_years, coalesce(languages, '') AS languages,
             CASE WHEN title LIKE 'Intern%' OR w.doc_id % 14 = 0 THEN 'intern' WHEN title LIKE 'Lead%' THEN 'lead' WHEN title LIKE 'Senior%' OR title LIKE 'Expert%' THEN 'senior' WHEN title LIKE 'Junior%' THEN 'junior'
                  WHEN y >= 6 THEN 'senior' WHEN y >= 3 THEN 'mid' WHEN y IS NOT NULL THEN 'junior' ELSE 'unspecified' END AS seniority,
             'onsite' AS workplace, CASE WHEN en >= fr AND en >= de THEN 'en' WHEN fr >= de THEN 'fr' ELSE 'de' END AS posting_language
      FROM w LEFT JOIN per USING (doc_id)""",
}
