"""Scoring, ranking and set operators over the order tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cv as C
from ..operators import judge as J
from ..operators import mentions as M
from ..operators import scoring as S
from ..operators import tailor as L
from ..functions import vocab as V
from ..sources import feeds, saved
from ..cluster import spread_by
from .tables import JUDGMENTS_SQL, judgments, line_rows, table


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    score = j.groupBy("cv_id", "job_id").agg(F.max("retrieval_score").alias("retrieval_score"))
    return S.coverage(j).join(score, ["cv_id", "job_id"])


def coverage_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(judgments(spark, sf_dir)).select(
        "cv_id", "job_id", F.round("must_coverage", 6).alias("must_coverage"), F.round("nice_coverage", 6).alias("nice_coverage"), "fit"
    )


def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_analyses(_analyses(spark, sf_dir)).select("cv_id", "job_id", "fit", "rank")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.verdict_counts(judgments(spark, sf_dir)).select("cv_id", "job_id", "kind", "total", "met", "partial", "missing")


def fit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cv_id"), F.col("c_mktsegment").alias("segment"))
    return S.fit_bands(S.coverage(judgments(spark, sf_dir)).join(segment, "cv_id"), ["segment"])


def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = spread_by(judgments(spark, sf_dir), line_rows(spark, sf_dir), "cv_id", "skill")
    return S.skill_demand(j.where("verdict = 'met'").select("cv_id", "skill"), j.select("cv_id", "job_id", "skill"))


def combine_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    keys = ["cv_id", "job_id"]
    every = J.combine_all(j, keys).withColumnRenamed("verdict", "all_of")
    order = j.withColumn("at", F.col("req_no") * 1000 + F.substring("skill", 7, 3).cast("int"))
    best = J.combine_any(order, keys, "at", "skill").withColumnRenamed("verdict", "any_of")
    return every.join(best, keys)


def learn_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    j = spread_by(judgments(spark, sf_dir), rows, "cv_id", "job_id")
    return S.top_learn(S.learn_next(j, S.coverage(j), rows)).withColumn("job_ids", F.array_join(F.col("job_ids").cast("array<string>"), ","))


def select_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.rank_analyses(_analyses(spark, sf_dir))
    picks = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"))
    return S.select_jobs(ranked, picks)


def experience_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    spans = o.select(F.col("o_custkey").alias("cv_id"), a.alias("a"), (a + 1 + (F.col("o_orderkey") % 7).cast("int")).alias("b"))
    return C.covered_months(spans, ["cv_id"]).select("cv_id", "months", F.round(F.col("months") / 12, 1).alias("years"))


def candidate_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = experience_months(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cv_id"), "c_mktsegment")
    x = c.join(months, "cv_id", "left").withColumn("years", F.coalesce("years", F.lit(0.0)))
    level = C.candidate_seniority(F.col("c_mktsegment") == "BUILDING", F.col("years"))
    return x.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n_candidates"))


def flags_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and seniority flags of (customer, order) pairs."""
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"))
    k = F.col("o_orderkey")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "lead").when(F.col("o_orderpriority") == "5-LOW", "intern").otherwise("unspecified")
    place = F.when(k % 5 == 0, "Berlin, Germany").when(k % 5 == 1, "Remote (US only)").when(k % 5 == 2, "Paris").otherwise("")
    workplace = F.when(k % 5 == 1, "remote").otherwise("onsite")
    postings = orders.select(k.alias("job_id"), place.alias("location"), workplace.alias("workplace"))
    facts = orders.select(
        k.alias("job_id"), (k % 8).cast("double").alias("min_years"), F.when(k % 3 == 0, F.array(F.lit("French"))).otherwise(F.array().cast("array<string>")).alias("languages"),
        level.alias("seniority"), workplace.alias("workplace"), F.when(k % 4 == 0, "de").otherwise("en").alias("posting_language"),
    )
    c = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select(
        c.alias("cv_id"), F.when(c % 2 == 0, "Lyon, France").otherwise("Tunis").alias("location"), (c % 6).cast("double").alias("years_experience"),
        F.when(c % 3 == 0, "student").when(c % 3 == 1, "mid").otherwise("senior").alias("seniority"),
        F.create_map(F.lit("French"), (c % 5).cast("int"), F.lit("German"), (c % 4).cast("int")).alias("languages"),
    )
    return S.flags(pairs, postings, facts, profiles).groupBy("flag", "message").agg(F.count(F.lit(1)).alias("n"))


def implied_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations imply the one before and the one with half their key: chains of up to 24, and diamonds. Customers own their nation."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    other = n.select(F.col("n_nationkey").alias("parent"), F.col("n_name").alias("implied"))
    parents = n.where("n_nationkey > 0").select("n_name", F.explode(F.array(F.col("n_nationkey") - 1, F.floor(F.col("n_nationkey") / 2).cast("int"))).alias("parent"))
    edges = parents.join(other, "parent").select(F.col("n_name").alias("skill"), "implied")
    owned = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cv_id"), F.col("n_name").alias("skill"))
    got = M.implied_skills(owned, "cv_id", V.implication_closure(edges))
    return got.groupBy("skill", "implied_by").agg(F.count(F.lit(1)).alias("n_candidates"))


def related_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    skills = part.groupBy(F.col("p_brand").alias("skill")).agg(F.collect_set(F.concat_ws("-", "p_type", "p_size")).alias("groups"))
    return V.related_pairs(skills)


def evidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as external verdicts that cite candidate lines, some of which do not exist."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max(F.struct("l_partkey", "l_quantity", "l_suppkey", "l_returnflag")).alias("x"))
        .select("l_orderkey", "l_linenumber", "x.*")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("cv_id"), F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("req_no"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "p_brand")
    )
    asked = li.select("cv_id", "job_id", "req_no", F.when(F.col("l_returnflag") == "N", "nice").otherwise("must").alias("kind"), F.array("p_brand").alias("skills"))
    verdict = F.when(F.col("l_quantity") >= 30, "met").when(F.col("l_quantity") >= 15, "partial").otherwise("missing")
    verdicts = li.where("l_quantity > 5").select(
        "cv_id", "job_id", "req_no", verdict.alias("verdict"),
        F.array(F.concat(F.lit("E"), (F.col("l_partkey") % 12).cast("string")), F.concat(F.lit(" E"), (F.col("l_suppkey") % 12).cast("string"))).alias("evidence_ids"),
        F.lit("n").alias("note"), F.lit("a").alias("cv_term"), F.when(F.col("l_partkey") % 2 == 0, "A").otherwise("b").alias("jd_term"),
    )
    units = orders.select(F.col("o_custkey").alias("cv_id"), F.concat(F.lit("E"), (F.col("o_orderkey") % 9).cast("string")).alias("unit_id")).distinct()
    owned = li.where("l_quantity >= 40").select("cv_id", F.col("p_brand").alias("skill")).distinct()
    out = J.evidence_guard(verdicts, asked, units, owned)
    return out.select(
        "cv_id", "job_id", "req_no", "verdict", F.array_join("evidence_ids", ",").alias("evidence"), "gap_type",
        F.array_join("missing_skills", ",").alias("missing"), "downgraded",
    )


def downgrade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.downgrade_totals(evidence_guard(spark, sf_dir))


def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("title"), F.col("value").alias("score"), F.col("event_id").alias("ingest_seq")
    )
    clicks, rest = e.where("title = 'click'"), e.where("title <> 'click'")
    return feeds.merge_pool(clicks, rest).select("job_id", "title", F.round("score", 4).alias("score"), "ingest_seq", "first_seq")


SAVED_PLACES = 60


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves of a posting; a purchase takes it off the list."""
    op = F.when(F.col("event_type") == "purchase", "remove").otherwise("save")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("saved_at"), op.alias("op"), F.col("event_type").alias("title"))


def saved_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved.upsert_saved(None, _saves(spark, sf_dir)).select("job_id", "title", "saved_at", "position")


def saved_full_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with a fixed number of places: the feature under test."""
    return saved.upsert_saved(None, _saves(spark, sf_dir), limit=SAVED_PLACES).select("job_id", "title", "saved_at", "position")


def saved_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved.refused_saves(None, _saves(spark, sf_dir), SAVED_PLACES).select("job_id", "title", "saved_at", "place")


def tailoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as drafts: the line number is the attempt, a quantity under 20 is a rejected draft."""
    li = spread_by(table(spark, sf_dir, "lineitem"), line_rows(spark, sf_dir), "l_orderkey")
    j = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    drafts = j.groupBy(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_quantity").alias("q"))
    checked = drafts.select(
        "cv_id", "job_id", "attempt", F.lit("original").alias("original"), F.concat(F.lit("draft "), F.col("attempt").cast("string")).alias("draft"),
        F.when(F.col("q") < 20, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("problems"),
    )
    tailored = L.verify_drafts(checked, ["cv_id", "job_id"])
    return L.tailoring_summary(tailored, checked)


QUERIES = {
    f.__name__: f
    for f in (
        coverage_fit, final_rank, verdict_counts, fit_bands, skill_demand, combine_all_any, learn_next, select_jobs, experience_months,
        candidate_seniority, flags_count, implied_skills, related_skills, evidence_guard, downgrade_totals, pool_merge, saved_upsert, saved_full_list, saved_refused, tailoring_summary,
    )
}

_GUARD_SQL = """
li AS (
  SELECT l_orderkey, l_linenumber, max({'p': l_partkey, 'q': l_quantity, 's': l_suppkey, 'f': l_returnflag}) AS x FROM lineitem GROUP BY ALL),
asked AS (
  SELECT o_custkey AS cv_id, l_orderkey AS job_id, l_linenumber AS req_no, x.p AS pk, x.q AS q, x.s AS sk, x.f AS f, p_brand
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON x.p = p_partkey),
units AS (SELECT DISTINCT o_custkey AS cv_id, 'E' || (o_orderkey % 9) AS unit_id FROM orders),
owned AS (SELECT DISTINCT cv_id, p_brand FROM asked WHERE q >= 40),
v AS (
  SELECT a.*, q > 5 AS judged, CASE WHEN q >= 30 THEN 'met' WHEN q >= 15 THEN 'partial' ELSE 'missing' END AS said,
         u1.unit_id AS e1, u2.unit_id AS e2, o.p_brand IS NOT NULL AS has
  FROM asked a LEFT JOIN units u1 ON u1.cv_id = a.cv_id AND u1.unit_id = 'E' || (pk % 12)
  LEFT JOIN units u2 ON u2.cv_id = a.cv_id AND u2.unit_id = 'E' || (sk % 12)
  LEFT JOIN owned o ON o.cv_id = a.cv_id AND o.p_brand = a.p_brand),
w AS (SELECT *, judged AND said IN ('met', 'partial') AND e1 IS NULL AND e2 IS NULL AS downgraded FROM v),
guard AS (
  SELECT *, CASE WHEN NOT judged OR downgraded THEN 'missing' ELSE said END AS verdict FROM w)
"""

_ARRIVALS_SQL = """
l AS (SELECT user_id AS job_id, arg_max(event_type, event_id) AS title, max(event_id) AS saved_at, max(event_id) FILTER (event_type = 'purchase') AS gone FROM events GROUP BY user_id),
f AS (SELECT job_id, title, saved_at, min(event_id) AS first FROM l JOIN events ON user_id = job_id WHERE event_type <> 'purchase' AND event_id > coalesce(gone, -1) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY first, job_id) AS place FROM f WHERE title <> 'purchase')"""

ORACLES = {
    "coverage_fit": f"WITH {JUDGMENTS_SQL} SELECT cv_id, job_id, round(must_coverage, 6) AS must_coverage, round(nice_coverage, 6) AS nice_coverage, fit FROM fits",
    "final_rank": f"WITH {JUDGMENTS_SQL} SELECT cv_id, job_id, fit, row_number() OVER (PARTITION BY cv_id ORDER BY fit DESC, retrieval_score DESC, job_id) AS rank FROM fits",
    "verdict_counts": f"""WITH {JUDGMENTS_SQL}
      SELECT cv_id, job_id, coalesce(kind, 'all') AS kind, count(*) AS total, count(*) FILTER (verdict = 'met') AS met,
             count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'missing') AS missing
      FROM judged GROUP BY GROUPING SETS ((cv_id, job_id, kind), (cv_id, job_id))""",
    "fit_bands": f"""WITH {JUDGMENTS_SQL}
      SELECT c_mktsegment AS segment, CASE WHEN fit >= 0.75 THEN 'high' WHEN fit >= 0.5 THEN 'mid' ELSE 'low' END AS band, count(*) AS n_jobs
      FROM fits JOIN customer ON cv_id = c_custkey GROUP BY ALL""",
    "skill_demand": f"""WITH {JUDGMENTS_SQL}, own AS (SELECT DISTINCT cv_id, skill FROM judged WHERE verdict = 'met')
      SELECT o.cv_id, o.skill, count(DISTINCT j.job_id) AS n_jobs FROM own o LEFT JOIN judged j ON j.cv_id = o.cv_id AND j.skill = o.skill GROUP BY ALL""",
    "combine_all_any": f"""WITH {JUDGMENTS_SQL}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY cv_id, job_id ORDER BY v DESC, req_no * 1000 + substr(skill, 7, 3)::INTEGER) AS i FROM judged)
      SELECT cv_id, job_id, CASE WHEN bool_and(verdict = 'met') THEN 'met' WHEN bool_or(verdict <> 'missing') THEN 'partial' ELSE 'missing' END AS all_of,
             max(verdict) FILTER (i = 1) AS any_of, max(CASE WHEN verdict <> 'met' THEN skill END) FILTER (i = 1) AS missing_label
      FROM ranked GROUP BY ALL""",
    "learn_next": f"""WITH {JUDGMENTS_SQL},
      gaps AS (SELECT cv_id, job_id, kind, verdict, (2 * v)::BIGINT AS v, len(list_distinct(missing_skills)) AS n, unnest(list_distinct(missing_skills)) AS skill FROM judged WHERE verdict <> 'met'),
      delta AS (
        SELECT cv_id, job_id, skill, bool_or(kind = 'must') AS asked_must,
               sum(CASE WHEN kind = 'must' THEN d ELSE 0 END)::BIGINT AS dm, sum(CASE WHEN kind = 'nice' THEN d ELSE 0 END)::BIGINT AS dn
        FROM (SELECT *, CASE WHEN n = 1 THEN 2 WHEN verdict = 'missing' THEN 1 ELSE v END - v AS d FROM gaps) GROUP BY ALL),
      sim AS (
        SELECT cv_id, job_id, skill, asked_must, ms < 2 * mn AND ms + dm = 2 * mn AS opened, fit,
               (2 * CASE WHEN mn > 0 AND nn > 0 THEN 3750 * (ms + dm) * nn + 1250 * (ns + dn) * mn ELSE 5000 * (ms + dm + ns + dn) END + greatest(mn, 1) * greatest(nn, 1))
               // (2 * greatest(mn, 1) * greatest(nn, 1)) / 10000.0::DOUBLE AS fit2
        FROM delta JOIN fits USING (cv_id, job_id)),
      items AS (
        SELECT cv_id, skill, count(*) AS jobs_requiring, count(*) FILTER (asked_must) AS must_count, count(*) FILTER (opened) AS unlocks,
               (2 * sum(round(greatest(0.0, fit2 - fit) * 10000)::BIGINT)::BIGINT + count(*)) // (2 * count(*)) / 10000.0::DOUBLE AS fit_gain,
               array_to_string(list_sort(list(DISTINCT job_id)), ',') AS job_ids
        FROM sim GROUP BY ALL)
      SELECT cv_id, skill, jobs_requiring, must_count, unlocks, fit_gain, job_ids, place::INTEGER AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY unlocks DESC, must_count DESC, jobs_requiring DESC, fit_gain DESC, skill) AS place FROM items)
      WHERE place <= 12""",
    "select_jobs": f"""WITH {JUDGMENTS_SQL}, r AS (
        SELECT cv_id, job_id, row_number() OVER (PARTITION BY cv_id ORDER BY fit DESC, retrieval_score DESC, job_id) AS rank FROM fits),
      p AS (SELECT r.*, row_number() OVER (PARTITION BY cv_id ORDER BY rank) AS i FROM r JOIN orders ON o_orderkey = job_id AND o_custkey = cv_id WHERE o_orderstatus = 'P')
      SELECT cv_id, job_id, rank FROM p WHERE i <= 3""",
    "experience_months": """WITH s AS (
        SELECT o_custkey AS cv_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 7 AS b FROM orders),
      m AS (SELECT *, max(b) OVER (PARTITION BY cv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cv_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
      i AS (SELECT cv_id, island, max(b) - min(a) AS n FROM g GROUP BY ALL)
      SELECT cv_id, sum(n)::BIGINT AS months, round(sum(n) / 12, 1) AS years FROM i GROUP BY cv_id""",
    "flags_count": """WITH x AS (
        SELECT o_orderkey AS k, c_custkey AS c, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'Berlin, Germany' WHEN o_orderkey % 5 = 1 THEN 'Remote (US only)'
          WHEN o_orderkey % 5 = 2 THEN 'Paris' ELSE '' END AS loc, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '5-LOW' THEN 0 END AS need,
          [0, 2, 3][c_custkey % 3 + 1] AS have, ['student', 'mid', 'senior'][c_custkey % 3 + 1] AS lvl
        FROM orders JOIN customer ON o_custkey = c_custkey),
      f AS (
        SELECT 'location' AS flag, CASE WHEN k % 5 = 1 THEN 'Remote, but limited to ' || loc ELSE 'On-site in ' || loc END AS message FROM x
          WHERE k % 5 IN (0, 1) OR (k % 5 = 2 AND true)
        UNION ALL SELECT 'language', 'Asks for French' FROM x WHERE k % 3 = 0 AND c % 5 < 3
        UNION ALL SELECT 'language', 'Posting is written in German' FROM x WHERE k % 4 = 0 AND c % 4 < 3
        UNION ALL SELECT 'seniority', CASE WHEN need - have >= 2 THEN 'Lead-level role; your CV reads ' || lvl
            WHEN k % 8 > c % 6 + 1.5 THEN 'Asks ' || (k % 8) || '+ years; your CV shows ' || CASE WHEN c % 6 < 0.5 THEN 'less than a year' ELSE 'about ' || (c % 6) END
            ELSE 'Internship; your CV reads more experienced' END
          FROM x WHERE need - have >= 2 OR k % 8 > c % 6 + 1.5 OR (p = '5-LOW' AND have >= 2))
      SELECT flag, message, count(*) AS n FROM f GROUP BY ALL""",
    "implied_skills": """WITH RECURSIVE edges AS (SELECT a.n_name AS skill, b.n_name AS implied FROM nation a JOIN nation b ON a.n_nationkey > 0 AND b.n_nationkey IN (a.n_nationkey - 1, a.n_nationkey // 2)),
      reach AS (SELECT skill, implied FROM edges UNION SELECT r.skill, e.implied FROM reach r JOIN edges e ON r.implied = e.skill)
      SELECT skill, implied_by, count(*) AS n_candidates FROM (
        SELECT n_name AS skill, NULL::VARCHAR AS implied_by FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT implied, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN reach ON skill = n_name WHERE implied <> n_name)
      GROUP BY ALL""",
    "related_skills": """WITH g AS (SELECT DISTINCT p_brand AS skill, p_type || '-' || p_size AS grp FROM part)
      SELECT DISTINCT a.skill, b.skill AS other FROM g a JOIN g b ON a.grp = b.grp AND a.skill <> b.skill""",
    "evidence_guard": f"""WITH {_GUARD_SQL}
      SELECT cv_id, job_id, req_no, verdict, CASE WHEN verdict = 'missing' THEN '' ELSE concat_ws(',', e1, e2) END AS evidence,
             CASE WHEN verdict = 'met' AND pk % 2 = 1 THEN 'wording' WHEN verdict = 'met' THEN 'none' ELSE 'skill' END AS gap_type,
             CASE WHEN NOT judged THEN p_brand WHEN verdict = 'met' THEN '' WHEN NOT has THEN p_brand WHEN verdict = 'missing' THEN p_brand ELSE '' END AS missing,
             downgraded FROM guard""",
    "downgrade_totals": f"WITH {_GUARD_SQL} SELECT cv_id, count(*) FILTER (downgraded) AS downgraded, count(*) AS judged FROM guard GROUP BY cv_id",
    "pool_merge": """SELECT user_id::VARCHAR AS job_id, arg_max(event_type, event_id) AS title, round(arg_max(value, event_id), 4) AS score,
      max(event_id) AS ingest_seq, min(event_id) AS first_seq FROM events GROUP BY user_id""",
    "saved_upsert": """WITH l AS (SELECT user_id AS job_id, arg_max(event_type, event_id) AS title, max(event_id) AS saved_at FROM events GROUP BY user_id)
      SELECT job_id, title, saved_at, row_number() OVER (ORDER BY saved_at DESC, job_id) AS position FROM l WHERE title <> 'purchase'""",
    "saved_full_list": f"""WITH {_ARRIVALS_SQL}
      SELECT job_id, title, saved_at, row_number() OVER (ORDER BY saved_at DESC, job_id) AS position FROM a WHERE place <= {SAVED_PLACES}""",
    "saved_refused": f"""WITH {_ARRIVALS_SQL} SELECT job_id, title, saved_at, place FROM a WHERE place > {SAVED_PLACES}""",
    "tailoring_summary": """WITH d AS (SELECT o_custkey AS cv_id, o_orderkey AS job_id, l_linenumber AS a, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
      b AS (SELECT cv_id, job_id, bool_or(q >= 20 AND a <= 3) AS ok, max(a) AS made FROM d GROUP BY ALL),
      s AS (SELECT cv_id, count(*) AS bullets, count(*) FILTER (ok) AS verified, count(*) FILTER (NOT ok AND made >= 3) AS kept_original FROM b GROUP BY cv_id)
      SELECT s.*, r.rejected_drafts FROM s JOIN (SELECT cv_id, count(*) FILTER (q < 20) AS rejected_drafts FROM d GROUP BY cv_id) r USING (cv_id)""",
}
ORACLES["candidate_seniority"] = f"""WITH e AS ({ORACLES['experience_months']}),
  y AS (SELECT c_mktsegment = 'BUILDING' AS student, coalesce(years, 0.0) AS years FROM customer LEFT JOIN e ON cv_id = c_custkey)
  SELECT CASE WHEN student AND years < 1 THEN 'student' WHEN years < 2 THEN 'junior' WHEN years < 5 THEN 'mid' WHEN years < 9 THEN 'senior' ELSE 'lead' END AS level,
         count(*) AS n_candidates FROM y GROUP BY ALL"""
