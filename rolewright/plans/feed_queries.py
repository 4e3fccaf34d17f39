"""Sources and streams. Payloads are built row by row from documents and pages, then read back by the feed readers."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut_lineage, shared_folder
from ..functions import text as T
from ..operators import mentions as M
from ..operators import postings as P
from ..sources import copied, feeds
from ..streaming import jobs
from .tables import benchmark_aliases, clean_sql, html_text_sql, lines_sql, mentions_sql, table, texts, vocabulary_sql


def _shown(postings: DataFrame) -> DataFrame:
    return postings.select(
        "job_id", "company", "title", "location", "workplace", "url", "posted_at", F.array_join("tags", ",").alias("tags"), F.length("description").alias("n_chars")
    )


def _id(c: str) -> Column:
    return F.col(c).cast("string")


def feed_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = texts(spark, sf_dir, "pages")
    job = F.struct(
        _id("page_id").alias("id"), F.lit(" Role ").alias("title"), F.struct(F.lit("Remote, EU").alias("name")).alias("location"),
        F.col("url").alias("absolute_url"), F.lit("2024-01-02").alias("updated_at"), F.col("html").alias("content"),
        F.array(F.struct(F.lit("Data").alias("name")), F.struct(F.lit("").alias("name"))).alias("departments"),
    )
    raw = p.select(F.lit("acme-rail_co").alias("slug"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return _shown(feeds.normalise_greenhouse(raw))


def feed_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    job = F.struct(
        _id("doc_id").alias("id"), F.concat(F.lit("Role "), "lang").alias("text"),
        F.struct(F.lit("").alias("location"), F.array(F.lit("Paris"), F.lit("Hybrid Lyon")).alias("allLocations"), F.col("source").alias("team")).alias("categories"),
        F.when(F.col("lang") == "fr", "on-site").otherwise("").alias("workplaceType"), F.lit("https://l.example").alias("hostedUrl"), F.lit(1700000000000).alias("createdAt"),
        F.col("text").alias("descriptionPlain"), F.array(F.struct(F.lit(" You have ").alias("text"), F.lit("<ul><li>SQL</li></ul>").alias("content"))).alias("lists"),
        F.lit("Bye").alias("additionalPlain"),
    )
    return _shown(feeds.normalise_lever(d.select(F.col("source").alias("slug"), F.to_json(F.array(job)).alias("payload"))))


def feed_ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    k = F.col("doc_id")
    job = F.struct(
        F.when(k % 2 == 0, _id("doc_id")).alias("id"), F.lit("Role").alias("title"), F.lit("Tunis").alias("location"), (k % 5 != 0).alias("isListed"),
        (k % 3 == 0).alias("isRemote"), F.when(k % 4 == 0, "OnSite").alias("workplaceType"), F.col("text").alias("descriptionPlain"),
        F.concat(F.lit("https://a.example/x/u"), _id("doc_id"), F.lit("/")).alias("jobUrl"), F.col("lang").alias("department"),
    )
    return _shown(feeds.normalise_ashby(d.select(F.col("source").alias("slug"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))))


def feed_remotive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = texts(spark, sf_dir, "pages")
    k = F.col("page_id")
    job = F.struct(
        k.alias("id"), F.col("url"), F.lit("Role").alias("title"), F.when(k % 2 == 0, "").otherwise("Beta").alias("company_name"), F.lit("Data").alias("category"),
        F.lit("full_time").alias("job_type"), F.lit("2024-02-03T00:00:00").alias("publication_date"),
        F.when(k % 3 == 0, "Worldwide").when(k % 3 == 1, "Remote, US").alias("candidate_required_location"), F.col("html").alias("description"),
    )
    return _shown(feeds.normalise_remotive(p.select(F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))))


def feed_arbeitnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = texts(spark, sf_dir, "pages")
    k = F.col("page_id")
    job = F.struct(
        F.concat(F.lit("s-"), _id("page_id")).alias("slug"), F.lit("Gamma").alias("company_name"), F.lit("Role").alias("title"), F.col("html").alias("description"),
        (k % 2 == 0).alias("remote"), F.col("url"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.array(F.lit("c")).alias("job_types"),
        F.when(k % 3 == 0, "").otherwise("Berlin").alias("location"), F.lit(1700000000).alias("created_at"),
    )
    return _shown(feeds.normalise_arbeitnow(p.select(F.to_json(F.struct(F.array(job).alias("data"))).alias("payload"))))


def board_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as boards: even documents are on one system, odd ones on another; some specs name a system."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    ats = F.when(F.substring("source", 4, 3).cast("int") % 3 == 0, "lever").when(F.col("doc_id") % 2 == 0, "greenhouse").otherwise("ashby")
    postings = d.select(F.concat_ws(":", ats, "source", _id("doc_id")).alias("job_id"), ats.alias("source"))
    number = F.substring("source", 4, 3).cast("int")
    raw = F.when(number % 4 == 0, F.concat(F.lit("ashby:"), "source")).when(number % 4 == 1, F.concat(F.lit("https://jobs.lever.co/"), "source", F.lit("/"))).otherwise(F.col("source"))
    specs = d.select(raw.alias("raw"), "source").select("raw").distinct()
    got = feeds.resolve_boards(specs, postings)
    return got.groupBy("source", F.split("job_id", ":")[1].alias("board")).agg(F.count(F.lit(1)).alias("n_postings"))


def pasted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    text = F.concat(F.lit("Title: Role "), _id("doc_id"), F.lit("\nEntreprise: "), "source", F.lit("\n\n"), "text", F.lit("\n---\n"), "text")
    out = copied.split_pasted(d.select(F.col("doc_id").alias("batch_id"), text.alias("text")))
    return out.groupBy("company", "workplace").agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("job_id").alias("n_ids"), F.sum(F.length("description")).alias("n_chars"))


def captured_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    k = F.col("doc_id")
    caps = d.select(
        F.when(k % 3 == 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/role-"), (k + 1_000_000).cast("string"), F.lit("/?x=1"))).otherwise("https://e.example/jobs/1").alias("url"),
        F.concat(F.lit(" Role  "), _id("doc_id")).alias("title"), F.col("source").alias("company"), F.lit("").alias("location"),
        F.when(k % 2 == 0, "Hybrid Internship").otherwise("On-site").alias("top"), F.when(k % 5 == 0, "short").otherwise(F.concat(F.lit("About the job\n\n"), "text")).alias("description"),
        F.lit("").alias("page_text"), F.when(k % 5 == 0, F.col("text")).otherwise("").alias("selection"),
    )
    ok, bad = copied.captures_to_postings(caps)
    return ok.select("job_id", "title", "workplace", "url", F.array_join("tags", ",").alias("tags"), F.length("description").alias("n_chars"), F.lit("ok").alias("state")).unionByName(
        bad.select(F.lit("").alias("job_id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.lit("").alias("workplace"), "url", F.lit("").alias("tags"), F.lit(0).alias("n_chars"), F.lit("rejected").alias("state"))
    )


def copied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside a copied page: menu lines, title, company, place and age above, closing marker below."""
    d = texts(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("Skip to main content\nHome\nCompany "), "source", F.lit("\nRole "), _id("doc_id"), F.lit("\nParis, France · 2 weeks ago · 37 applicants\nHybrid\nFull-time\nEasy Apply\nAbout the job\n"),
        "text", F.lit("\nShow less\nSeniority level\nEntry"),
    )
    p = copied.extract_copied_pages(d.select(F.col("doc_id").alias("page_id"), text.alias("text")))
    return p.select("page_id", "title", "company", "location", "workplace", "internship", F.length("description").alias("n_chars"))


def _sectioned_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings in front of their first and their remaining lines."""
    d = texts(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^([^\n]*)", 1)
    rest = F.regexp_replace("text", r"^[^\n]*\n?", "")
    body = F.concat(F.lit("Intro words.\nRequirements:\n"), head, F.lit("\n3+ years of SQL\nNICE TO HAVE\n"), rest, F.lit("\nWhat we offer\nLunch"))
    return d.select(
        F.col("doc_id").cast("string").alias("job_id"), "source", F.when(F.col("doc_id") % 2 == 0, "Senior role").otherwise("Role").alias("title"),
        body.alias("description"), F.lit("unknown").alias("workplace"), F.array().cast("array<string>").alias("tags"),
    )


def posting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_postings(_sectioned_postings(spark, sf_dir)).groupBy("job_id", "section").agg(F.count(F.lit(1)).alias("n_lines"))


def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval lines of every posting, whole."""
    return P.content_chunks(_sectioned_postings(spark, sf_dir))


def _land(rows: DataFrame, folder: str) -> None:
    """One more file in a landing folder: one more batch."""
    rows.coalesce(1).write.mode("append").parquet(folder)


def _arriving(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return jobs.read_landing(spark, folder, like.schema, "parquet", max_files=1)


def _folders(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """Landing folder, results and checkpoint of one run."""
    run = uuid.uuid4().hex
    return tuple(shared_folder(spark, f"{name}-{kind}-{run}") for kind in ("land", "out", "state"))


def _since_epoch(unit: str, c: str) -> Column:
    """Whole units of local time since 1970, whatever the session time zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} AS timestamp_ntz))")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _thirds(events: DataFrame) -> list[DataFrame]:
    """Three batches in order of time, of about as many events each."""
    lo, hi = events.select(F.unix_micros("ts").alias("t")).agg(F.percentile_approx("t", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    t = F.unix_micros("ts")
    return [events.where(t < lo), events.where((t >= lo) & (t < hi)), events.where(t >= hi)]


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in three batches as postings keyed by user, the last one after a restart and with a tenth of the second sent again; the latest version of each remains."""
    land, out, ckpt = _folders(spark, "ingest")
    events = _events(spark, sf_dir)
    one, two, three = _thirds(events)
    shape = lambda df: df.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("title"), "value", F.col("ts").alias("landed_at"))
    for batches in ([one, two], [three.unionByName(two.where("event_id % 10 = 0"))]):
        for rows in batches:
            _land(rows, land)
        jobs.finish(jobs.start_ingest(_arriving(spark, land, events), shape, out, ckpt))
    return jobs.current_postings(spark, out).select("job_id", "title", F.round("value", 4).alias("value"), _since_epoch("MICROSECOND", "landed_at").alias("landed_us"))


def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-event windows computed by the stream alone, over three batches and a restart; the last window is the last version that the stream wrote."""
    land, out, ckpt = _folders(spark, "windows")
    shape = lambda df: df.select("ts", F.col("event_type").alias("node"), F.col("value").alias("ms"), F.col("props").alias("status"), F.col("event_id").alias("seq"))
    events = _events(spark, sf_dir)
    one, two, three = _thirds(events)
    for batches in ([one, two], [three]):
        for rows in batches:
            _land(rows, land)
        jobs.finish(jobs.start_windows(shape(_arriving(spark, land, events)), out, ckpt, window="1 hour", late="2 hours"))
    rows = jobs.current_windows(spark, out)
    return rows.select(_since_epoch("SECOND", "window_start").alias("window_s"), "node", "n_events", F.round("total_ms", 2).alias("total_ms"), "last_status")


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as starts and purchases as ends of a user's stage, over three batches and a restart. The very first event of all arrives last: it is too late and counts for nothing."""
    land, out, ckpt = _folders(spark, "durations")
    events = _events(spark, sf_dir)
    first = events.agg(F.min(F.struct("ts", "event_id")).alias("f")).select("f.event_id").first()[0]
    one, two, three = _thirds(events)
    status = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").otherwise("note")
    shape = lambda df: df.select("ts", F.col("user_id").alias("run_id"), F.lit("stage").alias("node"), status.alias("status"), F.col("event_id").alias("seq"))
    for batches in ([one.where(F.col("event_id") != first), two], [three.unionByName(one.where(F.col("event_id") == first))]):
        for rows in batches:
            _land(rows, land)
        jobs.finish(jobs.start_durations(shape(_arriving(spark, land, events)), out, ckpt, timeout="12 hours", late="2 hours"))
    got = jobs.stage_durations(spark, out)
    return got.select("run_id", F.col("start_seq").alias("event_id"), _since_epoch("MICROSECOND", "started").alias("started_us"), F.coalesce("ms", F.lit(-1)).alias("ms"), "status")


def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as postings in three batches and meet the static skills of the benchmark candidates. The second batch replaces every tenth text by one word, the third, after a
    restart, brings every twentieth back."""
    aliases = cut_lineage(benchmark_aliases(spark, sf_dir))
    b = M.tag_mentions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cv_id"), "text"), ["cv_id"], "text", aliases)
    cv_skills = cut_lineage(b.groupBy("cv_id").agg(F.collect_set("skill").alias("skills")))
    land, out, ckpt = _folders(spark, "triage")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.where("doc_id % 10 = 0").withColumn("text", F.lit("withdrawn"))

    def skills_of(batch: DataFrame) -> DataFrame:
        m = M.tag_mentions(batch.select(F.col("doc_id").alias("job_id"), "text"), ["job_id"], "text", aliases)
        return m.groupBy("job_id").agg(F.collect_set("skill").alias("skills"))

    enough = lambda n: F.greatest(F.lit(6), F.ceil(n * 0.6)).cast("int")
    for batches in ([docs.where("doc_id % 3 < 2 or doc_id % 10 = 0"), docs.where("doc_id % 3 = 2 and doc_id % 10 > 0").unionByName(again)], [docs.where("doc_id % 20 = 0")]):
        for rows in batches:
            _land(rows, land)
        jobs.finish(jobs.start_scoring(_arriving(spark, land, docs), cv_skills, skills_of, out, ckpt, enough, key="doc_id"))
    return jobs.current_pairs(spark, out).select("cv_id", "job_id", "n_overlap")


QUERIES = {
    f.__name__: f
    for f in (
        feed_greenhouse, feed_lever, feed_ashby, feed_remotive, feed_arbeitnow, board_resolution, pasted_postings, captured_postings, copied_pages,
        posting_sections, content_chunks, stream_upsert, stage_windows, stage_durations, stream_triage,
    )
}

_PAGE = f"WITH p AS (SELECT page_id, url, {html_text_sql('html')} AS t FROM pages)"
_DOC = f"WITH d AS (SELECT doc_id, source, lang, text, {clean_sql('text')} AS t FROM documents)"

ORACLES = {
    "feed_greenhouse": f"""{_PAGE} SELECT 'greenhouse:acme-rail_co:' || page_id AS job_id, 'Acme Rail Co' AS company, 'Role' AS title, 'Remote, EU' AS location, 'remote' AS workplace,
      url, '2024-01-02' AS posted_at, 'Data' AS tags, length(t)::INTEGER AS n_chars FROM p""",
    "feed_lever": f"""{_DOC} SELECT 'lever:' || source || ':' || doc_id AS job_id, upper(left(source, 1)) || substr(source, 2) AS company, 'Role ' || lang AS title,
      'Paris, Hybrid Lyon' AS location, CASE WHEN lang = 'fr' THEN 'onsite' ELSE 'hybrid' END AS workplace, 'https://l.example' AS url, '1700000000000' AS posted_at, source AS tags,
      length({clean_sql("text || chr(10) || chr(10) || 'You have' || chr(10) || '• SQL' || chr(10) || chr(10) || 'Bye'")})::INTEGER AS n_chars FROM d""",
    "feed_ashby": f"""{_DOC} SELECT 'ashby:' || source || ':' || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'u' || doc_id END AS job_id, upper(left(source, 1)) || substr(source, 2) AS company,
      'Role' AS title, 'Tunis' AS location, CASE WHEN doc_id % 4 = 0 THEN 'onsite' WHEN doc_id % 3 = 0 THEN 'remote' ELSE 'onsite' END AS workplace,
      'https://a.example/x/u' || doc_id || '/' AS url, NULL::VARCHAR AS posted_at, lang AS tags, length(t)::INTEGER AS n_chars FROM d WHERE doc_id % 5 <> 0""",
    "feed_remotive": f"""{_PAGE} SELECT 'remotive:' || page_id AS job_id, CASE WHEN page_id % 2 = 0 THEN 'Unknown company' ELSE 'Beta' END AS company, 'Role' AS title,
      CASE page_id % 3 WHEN 0 THEN 'Remote (Worldwide)' WHEN 1 THEN 'Remote, US' ELSE 'Remote' END AS location, 'remote' AS workplace, url, '2024-02-03T00:00:00' AS posted_at,
      'Data,full_time' AS tags, length(t)::INTEGER AS n_chars FROM p""",
    "feed_arbeitnow": f"""{_PAGE} SELECT 'arbeitnow:s-' || page_id AS job_id, 'Gamma' AS company, 'Role' AS title,
      CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'Remote' ELSE '' END WHEN page_id % 2 = 0 THEN 'Berlin (remote)' ELSE 'Berlin' END AS location,
      CASE WHEN page_id % 2 = 0 THEN 'remote' ELSE 'onsite' END AS workplace, url, '1700000000' AS posted_at, 'a,b,c' AS tags, length(t)::INTEGER AS n_chars FROM p""",
    "board_resolution": """WITH s AS (SELECT source AS board, substr(source, 4)::INTEGER AS k, doc_id FROM documents),
      p AS (SELECT board, k, CASE WHEN k % 3 = 0 THEN 'lever' WHEN doc_id % 2 = 0 THEN 'greenhouse' ELSE 'ashby' END AS ats FROM s),
      b AS (SELECT DISTINCT board, k, ats, CASE ats WHEN 'greenhouse' THEN 1 WHEN 'lever' THEN 2 ELSE 3 END AS o FROM p),
      w AS (SELECT board, arg_min(ats, o) AS ats FROM b WHERE CASE k % 4 WHEN 0 THEN ats = 'ashby' WHEN 1 THEN ats = 'lever' ELSE true END GROUP BY board)
      SELECT p.ats AS source, p.board, count(*) AS n_postings FROM p JOIN w ON p.board = w.board AND p.ats = w.ats GROUP BY ALL""",
    "copied_pages": f"""{_DOC} SELECT doc_id AS page_id, 'Role ' || doc_id AS title, 'Company ' || source AS company, 'Paris, France' AS location, 'hybrid' AS workplace, false AS internship,
      length(array_to_string(list_filter(string_split(t, chr(10)), lambda s: s <> ''), chr(10)))::INTEGER AS n_chars FROM d""",
    "posting_sections": f"""WITH l AS ({lines_sql('documents', 'doc_id', 'text')}), h AS (SELECT doc_id, string_split(text, chr(10))[1] AS head FROM documents),
      c AS (SELECT doc_id, count(*) FILTER (line_no = 1) AS first, count(*) FILTER (line_no > 1) AS rest FROM h LEFT JOIN l USING (doc_id) GROUP BY doc_id),
      x AS (SELECT doc_id, 'intro' AS section, 1 AS n FROM c UNION ALL SELECT doc_id, 'must', 1 + first FROM c UNION ALL SELECT doc_id, 'nice', rest FROM c
            UNION ALL SELECT doc_id, 'skip', 1 FROM c)
      SELECT doc_id::VARCHAR AS job_id, section, n::BIGINT AS n_lines FROM x WHERE n > 0""",
    "content_chunks": f"""WITH l AS ({lines_sql('documents', 'doc_id', 'text')})
      SELECT doc_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS chunk_no, text
      FROM (SELECT doc_id, line_no, text FROM l WHERE length(text) >= 12 UNION ALL SELECT doc_id, 1.5, '3+ years of SQL' FROM documents)""",
    "captured_postings": f"""{_DOC}, c AS (SELECT *, 'Role ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN length(t) >= 200 THEN t ELSE 'short' END ELSE t END AS body,
        CASE WHEN doc_id % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/role-' || (doc_id + 1000000) || '/?x=1' ELSE 'https://e.example/jobs/1' END AS sent FROM d)
      SELECT CASE WHEN doc_id % 3 = 0 THEN 'linkedin:' || (doc_id + 1000000) ELSE 'linkedin:' || left(sha1(lower(title || '|' || source)), 12) END AS job_id, title,
             CASE WHEN doc_id % 2 = 0 THEN 'hybrid' ELSE 'onsite' END AS workplace,
             CASE WHEN doc_id % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/' || (doc_id + 1000000) || '/' ELSE sent END AS url,
             CASE WHEN doc_id % 2 = 0 THEN 'Internship' ELSE '' END AS tags, length(body)::INTEGER AS n_chars, 'ok' AS state FROM c WHERE length(body) >= 80
      UNION ALL SELECT '', title, '', sent, '', 0, 'rejected' FROM c WHERE length(body) < 80""",
    "pasted_postings": f"""{_DOC}, c AS (
        SELECT doc_id, source, {clean_sql("'Title: Role ' || doc_id || chr(10) || 'Entreprise: ' || source || chr(10) || chr(10) || text")} AS block, t AS body, 1 AS i FROM d
        UNION ALL SELECT doc_id, source, t, t, 2 FROM d)
      SELECT CASE i WHEN 1 THEN source ELSE 'Pasted posting 2' END AS company,
             CASE WHEN regexp_matches(lower(body), 'remote|télétravail') THEN 'remote' WHEN contains(lower(body), 'hybrid') THEN 'hybrid' ELSE 'unknown' END AS workplace,
             count(*) AS n_postings, count(DISTINCT block) AS n_ids, sum(length(body))::BIGINT AS n_chars FROM c GROUP BY ALL""",
    "stream_upsert": """SELECT user_id::VARCHAR AS job_id, arg_max(event_type, ts) AS title, round(arg_max(value, ts), 4) AS value, epoch_us(max(ts)) AS landed_us FROM events GROUP BY user_id""",
    "stream_triage": f"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 20 = 10 THEN 'withdrawn' ELSE text END AS text FROM documents),
      {vocabulary_sql()}, {mentions_sql('mb', 'benchmark', 'item_id', 'text')}, {mentions_sql('md', 'now', 'doc_id', 'text')},
      cs AS (SELECT DISTINCT item_id AS cv_id, skill FROM mb), js AS (SELECT DISTINCT doc_id AS job_id, skill FROM md),
      n AS (SELECT cv_id, greatest(6, ceil(count(*) * 0.6::DOUBLE)) AS need FROM cs GROUP BY cv_id)
      SELECT cv_id, job_id, count(*)::INTEGER AS n_overlap FROM cs JOIN js USING (skill) JOIN n USING (cv_id) GROUP BY cv_id, job_id, need HAVING count(*) >= need""",
    "stage_durations": """WITH f AS (SELECT arg_min(event_id, {'t': ts, 'i': event_id}) AS first FROM events), e AS (SELECT * FROM events, f WHERE event_id <> first),
      wm AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 2 HOURS AS w FROM e),
      p AS (SELECT s.user_id AS run_id, s.event_id, s.ts, min(d.ts) AS finished FROM e s LEFT JOIN e d ON d.event_type = 'purchase' AND d.user_id = s.user_id AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 12 HOURS
            WHERE s.event_type = 'click' GROUP BY ALL)
      SELECT run_id, event_id, epoch_us(ts) AS started_us, coalesce((epoch_us(finished) - epoch_us(ts)) // 1000, -1) AS ms, CASE WHEN finished IS NULL THEN 'timed out' ELSE 'done' END AS status
      FROM p, wm WHERE finished IS NOT NULL OR ts + INTERVAL 12 HOURS < w""",
    "stage_windows": """SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_s, event_type AS node, count(*) AS n_events, round(sum(value), 2) AS total_ms,
      arg_max(props, event_id) AS last_status FROM events GROUP BY ALL""",
}
