"""Candidate texts: every evidence unit, every experience entry, section counters.

Documents become candidate texts: every 23rd line or so gets a heading, a bullet, a role line or a wrapped end, so that all states of the segmentation occur.
The DuckDB counterparts state the rules anew, with literal patterns, as windows over lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cv as C
from .tables import fold_sql, lit, texts

#: What stands before and after line i of document d where (d + i) % 23 is the key; 9 replaces the line.
_AROUND = {
    0: ("Experience\n", ""), 1: ("Engineer | Acme | 2019 - 2021\n• ", ""), 3: ("Data trainee at Beta\n", ""), 4: ("- ", "\nand more of it"),
    5: ("short words here\n", ""), 6: ("Projects\n1. ", ""), 7: ("Skills\n", ","), 8: ("Tools: SQL, Python\n", ""), 10: ("Education\nMaster of things 2018\n", ""),
    11: ("Bachelor degree\nSome school, 2014 - 2016\n", ""), 12: ("Licence 2012;\n", ""), 13: ("SUMMARY:\n", ""), 14: ("Certifications\n", "\nA short\n"),
    15: ("Langues\n", "\nFrench\n•\n"), 17: ("(with brackets) ", ""),
    18: ("Lead of the data group at the northern plant with nine good people, Jan 2019 - March 2021\n", ""),
}
_INSTEAD = {9: "Languages: English, German"}
_EVERY = 23


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, text): every document as a candidate text."""

    def around(line: Column, i: Column) -> Column:
        n = (F.col("doc_id") + i) % _EVERY
        out = F
        for k, (before, after) in _AROUND.items():
            out = out.when(n == k, F.concat(F.lit(before), line, F.lit(after)))
        for k, instead in _INSTEAD.items():
            out = out.when(n == k, F.lit(instead))
        return out.otherwise(line)

    d = texts(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("cv_id"), F.array_join(F.transform(F.split("text", "\n"), around), "\n").alias("text"))


def cv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence unit: number, section, text, context and kind."""
    return C.unit_table(C.segment(candidate_texts(spark, sf_dir)))


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the experience section of a candidate text, counted by section."""
    d = texts(spark, sf_dir, "documents")
    text = F.concat(F.lit("Jane Doe\n\nExperience\nEngineer | Acme | 2019 - 2021\n"), "text", F.lit("\nSkills: SQL, Python\nEducation\nMaster 2018"))
    return C.section_counts(C.unit_table(C.segment(d.select(F.col("doc_id").cast("string").alias("cv_id"), text.alias("text")))))


def experience_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every experience entry with its lines."""
    entries = C.segment(candidate_texts(spark, sf_dir)).select("cv_id", F.posexplode(C.experience_entries(F.col("lines"))).alias("at", "entry"))
    return entries.select("cv_id", (F.col("at") + 1).alias("entry_no"), F.size("entry").alias("n_lines"), F.array_join("entry", "\n").alias("text"))


QUERIES = {f.__name__: f for f in (cv_units, section_counts, experience_entries)}


def _text(s: str) -> str:
    return " || chr(10) || ".join(lit(p) for p in s.split("\n"))


def _around_sql() -> str:
    whens = [f"WHEN {k} THEN {_text(b)} || l || {_text(a)}" for k, (b, a) in _AROUND.items()] + [f"WHEN {k} THEN {_text(t)}" for k, t in _INSTEAD.items()]
    return f"CASE (doc_id + i - 1) % {_EVERY} {' '.join(whens)} ELSE l END"


CANDIDATE_TEXTS_SQL = f"""
cvs AS (
  SELECT doc_id::VARCHAR AS cv_id, string_agg({_around_sql()}, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  GROUP BY doc_id)"""
COUNTED_TEXTS_SQL = """
cvs AS (
  SELECT doc_id::VARCHAR AS cv_id, 'Jane Doe' || chr(10) || chr(10) || 'Experience' || chr(10) || 'Engineer | Acme | 2019 - 2021' || chr(10) || text || chr(10) || 'Skills: SQL, Python'
    || chr(10) || 'Education' || chr(10) || 'Master 2018' AS text FROM documents)"""

# The rules, stated for the headings that occur here.
_HEADS = "experience|projects|skills|tools|languages|langues|education|summary|certifications"
_SECTION = "CASE {0} WHEN 'tools' THEN 'skills' WHEN 'langues' THEN 'languages' ELSE {0} END"
_YEAR_SQL = r"\b(19|20)[0-9]{2}\b"
_POINT_SQL = r"(((jan|feb|fev|mar|march|apr|avr|may|mai|jun|june|jul|july|aug|sep|oct|nov|dec)[.]?\s+)?([0-9]{1,2}\s*/\s*)?(19|20)[0-9]{2})"
_DATES_SQL = rf"{_POINT_SQL}\s*(-|to|a|au|until|jusqu'a|bis)\s*({_POINT_SQL}|present|current|now|today|ongoing|aujourd'hui|actuel|en cours|heute|date)"
_ROLE_SQL = (
    r"\b(engineer|ingenieur|intern|stagiaire|analyst|analyste|developer|developpeur|technician|technicien|manager|"
    r"responsable|consultant|scientist|assistant|lead|head|officer|specialist|coordinator|planner|apprenti)\b"
)
_DEGREE_SQL = r"\b(master|bachelor|licence|engineering degree|diplome|ingenieur|cycle|bac|phd|msc|bsc|degree|baccalaureat)\b"
_RUN = r"^([•●▪◦‣∙·○■□◆◇➢➤►▶✓✔☑❖→⁃*–\-]+|\(?[0-9]{1,2}[.)])\s+"
_SOLID = r"^[•●▪◦‣∙○■□◆◇➢➤►▶✓✔☑❖]."
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _bullet_sql(x: str) -> tuple[str, str]:
    s = _STRIP.format(x)
    is_bullet = f"(regexp_matches({s}, {lit(_RUN)}) OR regexp_matches({s}, {lit(_SOLID)}))"
    body = f"CASE WHEN regexp_matches({s}, {lit(_RUN)}) THEN regexp_replace({s}, {lit(_RUN)}, '') WHEN regexp_matches({s}, {lit(_SOLID)}) THEN substr({s}, 2) ELSE {s} END"
    return is_bullet, _STRIP.format(f"({body})")


SECTIONED_SQL = f"""
raw_lines AS (SELECT cv_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM (SELECT cv_id, string_split(text, chr(10)) AS ls FROM cvs)),
stripped AS (SELECT *, {_STRIP.format("regexp_replace(" + _STRIP.format("raw") + ", '^[#*_=—:|•-]+|[#*_=—:|•-]+$', '', 'g')")} AS s FROM raw_lines),
named AS (SELECT *, CASE WHEN s <> '' AND length(s) <= 60 THEN regexp_replace(regexp_replace({fold_sql('s')}, '\\s+', ' ', 'g'), '^[ :]+|[ :]+$', '', 'g') END AS f FROM stripped),
heads AS (
  SELECT cv_id, i, raw,
         CASE WHEN regexp_full_match(f, '{_HEADS}') THEN {_SECTION.format('f')}
              WHEN regexp_matches(f, '^({_HEADS})\\s*[:\\-|]\\s*(.+)$') THEN {_SECTION.format(f"regexp_extract(f, '^({_HEADS})', 1)")} END AS head,
         CASE WHEN regexp_full_match(f, '{_HEADS}') THEN '' WHEN regexp_matches(f, '^({_HEADS})\\s*[:\\-|]\\s*(.+)$')
              THEN trim(right(s, length(regexp_extract(f, '^({_HEADS})\\s*[:\\-|]\\s*(.+)$', 2)))) END AS inline
  FROM named),
islands AS (SELECT *, count(*) FILTER (inline = '') OVER (PARTITION BY cv_id ORDER BY i) AS island FROM heads),
opened AS (
  SELECT *, head IS NOT NULL AND (inline = '' OR NOT coalesce(bool_or(head = 'skills') OVER (PARTITION BY cv_id, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS opens
  FROM islands),
sectioned AS (
  SELECT cv_id, i, CASE WHEN opens THEN inline ELSE raw END AS raw,
         coalesce(last_value(CASE WHEN opens THEN head END IGNORE NULLS) OVER d, 'header') AS section, count(*) FILTER (opens) OVER d AS block
  FROM opened WINDOW d AS (PARTITION BY cv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
parts AS (
  SELECT *, {_bullet_sql('raw')[0]} AS bullet, {_bullet_sql('raw')[1]} AS body
  FROM sectioned WHERE section <> 'header' AND trim(raw) <> ''),
counted AS (
  SELECT *, {fold_sql('body')} AS f, len(regexp_extract_all(body, '\\S+')) AS n, len(list_filter(regexp_extract_all(body, '\\S+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) AS caps FROM parts),
told AS (
  SELECT *, regexp_matches(f, {lit(_DATES_SQL)}) OR (regexp_matches(f, {lit(_YEAR_SQL)}) AND n <= 12) OR (contains(f, '|') AND n <= 16)
            OR (n <= 9 AND regexp_matches(f, {lit(_ROLE_SQL)}) AND NOT ends_with(body, '.'))
            OR (n <= 6 AND NOT regexp_matches(body, '[.;]$') AND caps >= greatest(1, n - 1)) AS meta,
         regexp_matches(body, '^\\p{{Ll}}') AS lower, regexp_matches(body, {lit(_YEAR_SQL)}) AS year, regexp_matches(body, {lit(_YEAR_SQL)}) OR regexp_matches(f, {lit(_DEGREE_SQL)}) AS starts
  FROM counted)"""

UNITS_SQL = f"""
facts AS (SELECT *, lag(body) OVER b AS prev, lag(year) OVER b AS prev_year FROM told WHERE body <> '' WINDOW b AS (PARTITION BY cv_id, block ORDER BY i)),
marked AS (
  SELECT *, lower OR NOT regexp_matches(prev, '[.!?;]$') AS runs FROM facts),
states AS (
  SELECT *, coalesce(last_value(CASE WHEN bullet THEN true WHEN meta THEN false WHEN n >= 6 THEN true WHEN coalesce(runs, false) THEN NULL ELSE false END IGNORE NULLS) OVER b, false) AS open,
         coalesce(last_value(CASE WHEN year THEN true WHEN starts THEN false END IGNORE NULLS) OVER b, false) AS dated
  FROM marked WINDOW b AS (PARTITION BY cv_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
roles AS (
  SELECT *, section IN ('experience', 'projects') AS work, NOT bullet AND NOT meta AND open AND coalesce(runs, false) AS goes_on FROM states),
kinds AS (
  SELECT *, work AND NOT bullet AND NOT goes_on AND (meta OR n < 6) AS role, work AND NOT bullet AND NOT goes_on AND meta AND open AS renews,
         CASE WHEN work THEN CASE WHEN bullet OR (NOT goes_on AND NOT meta AND n >= 6) THEN 'new' WHEN goes_on THEN ' ' END
              WHEN section = 'skills' THEN CASE WHEN prev IS NOT NULL AND (regexp_matches(prev, '[,/&-]$') OR lower OR starts_with(body, '(')) THEN ' ' ELSE 'new' END
              WHEN section = 'education' THEN CASE WHEN prev IS NULL OR (starts AND dated) THEN 'new' WHEN NOT prev_year AND NOT regexp_matches(prev, '[.;:)]$') THEN ' ' ELSE ' — ' END
              WHEN section = 'summary' THEN CASE WHEN prev IS NULL THEN 'new' ELSE ' ' END
              WHEN section = 'languages' THEN CASE WHEN prev IS NULL THEN 'new' ELSE '; ' END
              WHEN n >= 3 THEN 'new' END AS glue
  FROM roles),
grouped AS (SELECT *, count(*) FILTER (renews) OVER (PARTITION BY cv_id, block ORDER BY i) AS since FROM kinds),
above AS (
  SELECT *, CASE WHEN role THEN concat_ws(' | ', last_value(CASE WHEN role THEN body END IGNORE NULLS) OVER r, body) END AS pair
  FROM grouped WINDOW r AS (PARTITION BY cv_id, block, since ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (
  SELECT *, CASE WHEN work THEN coalesce(last_value(pair IGNORE NULLS) OVER (PARTITION BY cv_id, block, since ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS context,
         count(*) FILTER (glue = 'new') OVER (PARTITION BY cv_id ORDER BY i) AS unit
  FROM above),
joined AS (
  SELECT cv_id, unit, any_value(section) AS section, string_agg(CASE WHEN glue = 'new' THEN body ELSE glue || body END, '' ORDER BY i) AS text, arg_min(context, i) AS context
  FROM placed WHERE glue IS NOT NULL GROUP BY cv_id, unit),
found AS (
  SELECT cv_id, unit, section, text, context, CASE WHEN section IN ('experience', 'projects') THEN 'bullet' WHEN section IN ('skills', 'education', 'summary', 'languages') THEN section ELSE 'line' END AS kind
  FROM joined WHERE section <> 'skills' OR length(text) >= 2),
loose AS (SELECT cv_id, i AS unit, 'other' AS section, {_bullet_sql('raw')[1]} AS text, '' AS context, 'line' AS kind FROM raw_lines WHERE i > 1),
sentences AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;])\\s+([A-Z0-9À-Ý])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ss
  FROM (SELECT *, false AS spare FROM found UNION ALL SELECT *, true FROM loose WHERE len(regexp_extract_all(text, '\\S+')) >= 5)),
packed AS (
  SELECT *, CASE WHEN length(text) <= 420 OR len(ss) = 0 THEN [text]
    ELSE list_transform(string_split(list_reduce(ss, lambda a, x: CASE WHEN length(string_split(a, chr(30))[-1]) + length(x) > 420 THEN a || chr(30) || ' ' || x ELSE a || ' ' || x END), chr(30)), lambda x: trim(x)) END AS packs
  FROM (SELECT * REPLACE (list_concat([' ' || ss[1]], ss[2:]) AS ss) FROM sentences)),
enough AS (SELECT cv_id, coalesce(sum(CASE WHEN section = 'summary' THEN len(packs) ELSE 1 END) FILTER (NOT spare), 0) < 3 AS few FROM cvs LEFT JOIN packed USING (cv_id) GROUP BY cv_id),
units AS (
  SELECT cv_id, section, pack AS text, context, kind, row_number() OVER (PARTITION BY cv_id ORDER BY unit, k) AS unit_no
  FROM (SELECT packed.*, unnest(packs) AS pack, generate_subscripts(packs, 1) AS k FROM packed JOIN enough USING (cv_id) WHERE spare = few) WHERE length(pack) >= 3)"""

ORACLES = {
    "cv_units": f"WITH {CANDIDATE_TEXTS_SQL}, {SECTIONED_SQL}, {UNITS_SQL} SELECT cv_id, unit_no::INTEGER AS unit_no, 'E' || unit_no AS unit_id, section, text, context, kind FROM units",
    "section_counts": f"WITH {COUNTED_TEXTS_SQL}, {SECTIONED_SQL}, {UNITS_SQL} SELECT section, count(*) AS n_units, count(DISTINCT cv_id) AS n_cvs FROM units GROUP BY section",
    "experience_entries": f"""WITH {CANDIDATE_TEXTS_SQL}, {SECTIONED_SQL},
      e AS (SELECT *, meta AND NOT bullet AS role FROM told WHERE section = 'experience'),
      p AS (SELECT *, role AND NOT coalesce(lag(role) OVER (PARTITION BY cv_id ORDER BY i), true) AS first FROM e),
      n AS (SELECT *, 1 + count(*) FILTER (first) OVER (PARTITION BY cv_id ORDER BY i) AS entry_no FROM p)
      SELECT cv_id, entry_no::INTEGER AS entry_no, count(*)::INTEGER AS n_lines, string_agg(raw, chr(10) ORDER BY i) AS text FROM n GROUP BY cv_id, entry_no""",
}
