"""Match reports, whole texts: every section from the orders of a customer."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import spread_by
from ..operators.report import match_report
from .tables import line_rows, table


def match_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates, their orders as ranked postings, the lines of an order as judged requirements."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    profiles = customers.select(
        k.alias("cv_id"), F.when(k % 5 > 0, F.col("c_name")).otherwise("").alias("headline"), F.array("c_mktsegment", F.lit("analyst")).alias("target_titles"), F.when(k % 2 == 0, "mid").otherwise("student").alias("seniority"),
        (k % 50 / 10).alias("years_experience"), (k % 9).alias("internship_months"), F.create_map(F.lit("English"), k % 5 + 1, F.lit("French"), k % 3 + 1).alias("languages"),
        F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), k % 4), lambda i: F.concat(F.lit("skill "), i.cast("string")))).otherwise(F.array()).alias("skills"),
    )
    pair = (F.col("o_custkey").alias("cv_id"), o.alias("job_id"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = orders.select(*pair, place.alias("rank"), (o % 101 / 100).alias("fit"), F.when(o % 3 > 0, o % 7 / 10).alias("must_coverage"), F.when(o % 4 > 0, o % 11 / 10).alias("nice_coverage"))
    postings = orders.select(
        o.alias("job_id"), F.concat(F.lit("Role "), "o_orderpriority").alias("title"), F.concat(F.lit("Shop "), (o % 13).cast("string")).alias("company"),
        F.when(o % 2 == 0, F.concat(F.lit("https://example.org/"), o.cast("string"))).otherwise("").alias("url"), F.when(o % 3 == 0, "Lyon").when(o % 3 == 1, "").alias("location"),
        F.when(o % 5 == 0, "remote").otherwise("onsite").alias("workplace"), F.when(o % 6 == 0, "By courtesy").alias("attribution"), F.concat(F.lit("Feed "), (o % 4).cast("string")).alias("source_label"),
    )
    # lines that repeat a number within an order are one requirement
    rows = line_rows(spark, sf_dir)
    li = spread_by(table(spark, sf_dir, "lineitem"), rows, "l_orderkey").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("req_no"))
    li = li.agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"), F.max("l_returnflag").alias("flag"))
    requirements = li.select("job_id", "req_no", F.concat(F.lit("Knows part "), F.col("part").cast("string")).alias("text"), F.when(F.col("part") % 3 == 0, "nice").otherwise("must").alias("kind"))
    unit = F.concat(F.lit("E"), (F.col("supp") % 5).cast("string"))
    judgments = li.join(orders.select(*pair), "job_id").select(
        "cv_id", "job_id", "req_no", F.when(F.col("flag") == "R", "missing").when(F.col("flag") == "A", "partial").otherwise("met").alias("verdict"), F.lit("must").alias("kind"),
        F.when(F.col("flag") == "R", F.array()).otherwise(F.array(unit, F.lit("E1"))).alias("evidence_ids"), F.when(F.col("part") % 10 == 0, "wording").otherwise("none").alias("gap_type"),
        F.concat(F.lit("term "), (F.col("part") % 8).cast("string")).alias("cv_term"), F.concat(F.lit("word "), (F.col("supp") % 8).cast("string")).alias("jd_term"),
    )
    lines = customers.select(k.alias("cv_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "c_name", "c_mktsegment")
    units = lines.select("cv_id", F.concat(F.lit("E"), F.col("i").cast("string")).alias("unit_id"), F.concat("c_name", F.lit(" did "), "c_mktsegment", F.lit(" work, part "), F.col("i").cast("string")).alias("text"))
    notes = orders.where("o_orderkey % 5 = 1").select(*pair, F.explode(F.sequence(F.lit(1), o % 2 + 1)).alias("seq"))
    flags = notes.select("cv_id", "job_id", "seq", F.concat(F.lit("flag "), F.col("seq").cast("string")).alias("message"))
    asked = orders.groupBy(F.col("o_custkey").alias("cv_id"), F.col("o_orderpriority").alias("skill")).agg(F.count("*").alias("jobs_requiring"), F.sum((o % 2).cast("long")).alias("must_count"))
    by_need = Window.partitionBy("cv_id").orderBy(F.desc("jobs_requiring"), "skill")
    learn = asked.select("*", F.row_number().over(by_need).alias("place"), (F.col("jobs_requiring") % 3).alias("unlocks"), (F.col("must_count") % 20 / 100).alias("fit_gain"))
    written = orders.where("o_orderkey % 4 = 0").select(*pair, F.explode(F.array(F.lit(2), F.lit(1))).alias("unit_no"), "o_orderpriority")
    bullet = F.concat(F.lit("line "), F.col("unit_no").cast("string"))
    status = F.when(F.col("job_id") % 8 == 0, "verified").otherwise("kept_original")
    tailored = written.select("cv_id", "job_id", "unit_no", status.alias("status"), bullet.alias("original"), F.concat(bullet, F.lit(" for "), "o_orderpriority").alias("final"))
    tries = written.select("cv_id", "job_id", "unit_no", F.explode(F.array(F.lit(2), F.lit(1))).alias("attempt"))
    problem = F.concat(F.lit("new number "), F.col("attempt").cast("string"))
    checked = tries.select(
        "cv_id", "job_id", "unit_no", "attempt", F.concat(F.lit("draft "), F.col("attempt").cast("string")).alias("draft"),
        F.when((F.col("job_id") % 8 == 0) & (F.col("attempt") == 2), F.array()).otherwise(F.array(problem, F.lit("too long"))).alias("problems"),
    )
    return match_report(profiles, ranked, postings, requirements, judgments, units, flags, learn, tailored, checked, rows=rows)


_PERCENT = "CASE WHEN {0} IS NULL THEN '–' ELSE round({0} * 100)::INTEGER || '%' END"

QUERIES = {"match_reports": match_reports}

ORACLES = {
    "match_reports": f"""WITH o AS (SELECT o_custkey AS cv_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 'Role ' || o_orderpriority AS title, o_orderpriority AS pr,
        'Shop ' || (o_orderkey % 13) AS company, CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/' || o_orderkey ELSE '' END AS url, CASE o_orderkey % 3 WHEN 0 THEN 'Lyon' ELSE 'Location not stated' END AS place,
        CASE WHEN o_orderkey % 5 = 0 THEN 'remote' ELSE 'onsite' END AS workplace, CASE WHEN o_orderkey % 6 = 0 THEN 'By courtesy' ELSE 'Feed ' || (o_orderkey % 4) END AS named, (o_orderkey % 101) / 100.0 AS fit,
        CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7) / 10.0 END AS must, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 11) / 10.0 END AS nice,
        CASE WHEN o_orderkey % 5 <> 1 THEN '—' WHEN o_orderkey % 2 = 0 THEN 'flag 1' ELSE 'flag 1; flag 2' END AS flags FROM orders),
      li AS (SELECT l_orderkey AS job_id, l_linenumber AS r, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
      q AS (SELECT cv_id, job_id, rank, r, part, supp, flag, c_name || ' did ' || c_mktsegment || ' work, part ' AS t, supp % 5 AS u FROM li JOIN o USING (job_id) LEFT JOIN customer ON c_custkey = cv_id),
      tab AS (SELECT cv_id, job_id, string_agg('| Knows part ' || part || ' | ' || CASE WHEN part % 3 = 0 THEN 'nice' ELSE 'must' END || ' | ' || CASE flag WHEN 'R' THEN '✘ missing' WHEN 'A' THEN '◐ partial' ELSE '✔ met' END || ' | ' ||
               CASE WHEN flag = 'R' OR t IS NULL THEN '—' ELSE CASE WHEN u BETWEEN 1 AND 3 THEN 'E' || u || ': “' || t || u || '” / ' ELSE '' END || 'E1: “' || t || '1”' END ||
               CASE WHEN part % 10 = 0 THEN ' *(you write “term ' || (part % 8) || '”, they write “word ' || (supp % 8) || '”)*' ELSE '' END || ' |', chr(10) ORDER BY r) AS rows FROM q GROUP BY ALL),
      jobs AS (SELECT cv_id, string_agg('| ' || rank || ' | ' || CASE WHEN url <> '' THEN '[' || title || '](' || url || ')' ELSE title END || ' | ' || company || ' | ' || round(fit * 100)::INTEGER || ' | ' ||
                 {_PERCENT.format("must")} || ' | ' || {_PERCENT.format("nice")} || ' | ' || flags || ' |', chr(10) ORDER BY rank) AS l,
               string_agg(concat_ws(chr(10), '### ' || rank || '. ' || title || ' — ' || company, place || ' · ' || workplace || ' · source: ' || named, CASE WHEN url <> '' THEN 'Posting: ' || url END,
                 chr(10) || '| Requirement | Kind | Verdict | Evidence from your CV |' || chr(10) || '|---|---|---|---|', rows, ''), chr(10) ORDER BY rank) AS d FROM o LEFT JOIN tab USING (cv_id, job_id) GROUP BY cv_id),
      src AS (SELECT cv_id, string_agg('- ' || named, chr(10) ORDER BY named) AS l FROM (SELECT DISTINCT cv_id, named FROM o) GROUP BY cv_id),
      need AS (SELECT cv_id, pr, count(*) AS n, sum(job_id % 2)::BIGINT AS m FROM o GROUP BY ALL),
      learn AS (SELECT cv_id, string_agg('| ' || pr || ' | ' || n || ' | ' || m || ' | ' || (n % 3) || ' | +' || (m % 20) || ' pts |', chr(10) ORDER BY n DESC, pr) AS l FROM need GROUP BY cv_id),
      w AS (SELECT cv_id, job_id, rank, title, pr, unnest([1, 2]) AS u FROM o WHERE job_id % 4 = 0),
      bul AS (SELECT cv_id, string_agg('**For ' || title || '** (E' || u || ', ' || CASE WHEN job_id % 8 = 0 THEN 'verified' ELSE 'kept original' END || ')' || chr(10) || chr(10) || '- Before: line ' || u || chr(10) || '- After: line ' || u || ' for ' || pr ||
                chr(10) || '  - Rejected draft: “draft 1” — new number 1; too long' || CASE WHEN job_id % 8 = 0 THEN '' ELSE chr(10) || '  - Rejected draft: “draft 2” — new number 2; too long' END || chr(10), chr(10) ORDER BY rank, u) AS l FROM w GROUP BY cv_id)
      SELECT c_custkey AS cv_id, concat_ws(chr(10) || chr(10),
        '# CV-to-job match report' || chr(10) || chr(10) || 'mode: rules' || chr(10) || chr(10) || '## Profile' || chr(10) || '- **Headline:** ' || CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '—' END || chr(10) ||
          '- **Target titles:** ' || c_mktsegment || ', analyst' || chr(10) || '- **Seniority:** ' || CASE WHEN c_custkey % 2 = 0 THEN 'mid' ELSE 'student' END || ' (~' || (c_custkey % 50 / 10)::DOUBLE || ' years professional, ' || (c_custkey % 9) || ' months of internships)' || chr(10) ||
          '- **Languages:** English (' || (c_custkey % 5 + 1) || '/5), French (' || (c_custkey % 3 + 1) || '/5)' || chr(10) || '- **Skills found:** ' || CASE c_custkey % 4 WHEN 0 THEN '—' WHEN 1 THEN 'skill 1' WHEN 2 THEN 'skill 1, skill 2' ELSE 'skill 1, skill 2, skill 3' END,
        '## Ranked jobs' || chr(10) || chr(10) || '| # | Job | Company | Fit | Must-haves | Nice-to-haves | Flags |' || chr(10) || '|---|-----|---------|-----|------------|---------------|-------|' || chr(10) || jobs.l, jobs.d,
        '## Learn next' || chr(10) || chr(10) || '| Skill | Jobs asking | As must-have | Jobs fully unlocked | Avg. fit gain |' || chr(10) || '|---|---|---|---|---|' || chr(10) || learn.l || chr(10),
        '## Tailored bullets' || chr(10) || chr(10) || bul.l, '## Sources' || chr(10) || src.l) AS markdown
      FROM customer LEFT JOIN jobs ON jobs.cv_id = c_custkey LEFT JOIN learn ON learn.cv_id = c_custkey LEFT JOIN bul ON bul.cv_id = c_custkey LEFT JOIN src ON src.cv_id = c_custkey""",
}
