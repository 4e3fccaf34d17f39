"""The whole match run as one chain of tables: candidates and postings in, rankings and reports out."""
from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..cluster import cut_lineage, spread_small
from ..functions import roles as R
from ..functions import vocab as V
from ..operators import cv as C
from ..operators import judge as J
from ..operators import mentions as M
from ..operators import postings as P
from ..operators import retrieval as X
from ..operators import scoring as S
from ..operators import tailor as L
from ..operators import triage as G
from ..operators.report import match_report

PAIR = ["cv_id", "job_id"]


@dataclass
class Settings:
    as_of: date
    shortlist_size: int = X.SHORTLIST
    min_relevant: int = 15
    bullets_per_job: int = L.BULLETS_PER_JOB
    jobs_to_tailor: int = 3
    idf_scope: str = "pair"
    picked_sources: tuple[str, ...] = ("pasted", "linkedin")
    #: Limits, none by default: skills that count in triage, lines of a posting that are matched, musts and requirements of a posting that are judged.
    top_skills: int | None = None
    chunk_limit: int | None = None
    must_limit: int | None = None
    requirement_limit: int | None = None


@dataclass
class MatchRun:
    """Named result tables of a run."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def run_match(
    cvs: DataFrame,
    postings: DataFrame,
    skills: DataFrame,
    settings: Settings,
    keywords: DataFrame | None = None,
    picks: DataFrame | None = None,
    prefs: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    extra_profiles: DataFrame | None = None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
    study_fields: DataFrame | None = None,
) -> MatchRun:
    """Profiles, triage, shortlist, requirements, judgments, ranking, learn-next, tailored bullets and reports.

    Stage tables that several later stages read are materialised in the checkpoint folder; the costly line
    matching and judging run on triaged and shortlisted pairs only. Optional inputs: ``keywords(cv_id, keywords)``,
    ``picks(cv_id, job_id)``, ``prefs(cv_id, location)``, external ``verdicts`` or ``extra_profiles`` tables, ``vectors`` (of requirements and of lines, see
    ``judge.closest_by_vector``) that take the place of line matching for free-text requirements, and ``study_fields(concept, word)``.
    """
    spark = cvs.sparkSession
    aliases = cut_lineage(V.alias_table(skills))
    closure = cut_lineage(V.implication_closure(V.implies_edges(skills)))
    related = V.related_pairs(skills)
    families = R.family_table(spark)

    # Candidates
    prepared = cut_lineage(C.prepare(spread_small(cvs), aliases))
    accepted, rejects = C.quality_gate(prepared)
    units = C.unit_table(accepted)
    unit_mentions = cut_lineage(M.tag_mentions(units, ["cv_id", "unit_no"], "text", aliases))
    own_mentions = M.tag_mentions(accepted.select("cv_id", "text"), ["cv_id"], "text", aliases)
    profiles = C.build_profiles(accepted, C.skill_counts(own_mentions), settings.as_of)
    if extra_profiles is not None:
        terms = extra_profiles.select(F.explode("skills").alias("t"))
        profiles = C.merge_profiles(profiles, extra_profiles, M.canonicalise(terms, "t", skills, aliases))
    profiles = cut_lineage(profiles)

    # Postings
    pool = spread_small(postings)
    posting_mentions = cut_lineage(
        M.tag_mentions(pool.select("job_id", F.concat_ws("\n", "title", "description").alias("text")), ["job_id"], "text", aliases)
    )
    job_skills = cut_lineage(posting_mentions.groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("skills")))

    # Triage with a widened search
    plans = G.plan_queries(profiles, C.family_score_table(profiles), families, keywords)
    ranked_families = (
        C.family_score_table(profiles).where("score > 0")
        .withColumn("place", F.row_number().over(_by_family()))
        .where("place <= 3")
        .join(families.select("family", F.concat("titles", "synonyms").alias("titles")), "family")
        .groupBy("cv_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "titles"))), lambda x: x["titles"])).alias("titles"))
    )
    none = F.array().cast("array<string>")
    plans = cut_lineage(plans.join(ranked_families, "cv_id", "left").withColumn("titles", F.coalesce("titles", none)))
    top = profiles.select("cv_id", F.slice("skills", 1, settings.top_skills).alias("skills")) if settings.top_skills else profiles.select("cv_id", "skills")
    overlaps = cut_lineage(G.shared_skills(top, job_skills))
    search = G.widen_search(plans, postings, overlaps, settings.min_relevant)
    queries = search.select("cv_id", F.posexplode("queries").alias("pos", "query"))
    triaged = cut_lineage(G.triage(queries, postings, profiles, job_skills, settings.picked_sources, picks, settings.top_skills))

    # Shortlist
    query_text = profiles.select("cv_id", "headline", F.array_join("target_titles", " ").alias("titles")).join(
        accepted.select("cv_id", F.array_join(F.transform(F.filter("units", lambda u: u["section"] != "languages"), lambda u: u["text"]), " ").alias("body")), "cv_id"
    ).select("cv_id", F.concat_ws(" ", "headline", "titles", "body").alias("text"))
    query = cut_lineage(X.query_terms(query_text, profiles))
    docs = X.doc_tokens(pool, job_skills)
    stranded = cut_lineage(G.candidates_without_match(profiles, triaged))
    pairs = cut_lineage(triaged.select(*PAIR).distinct())
    chunks = _chunk_terms(pool, aliases, settings.chunk_limit)
    lines = _unit_terms(units, unit_mentions, profiles)
    cosines = X.line_cosines(pairs, chunks, lines, settings.idf_scope)
    scores = X.bm25_in_pool(docs.join(pairs.select("job_id").distinct(), "job_id", "left_semi"), query, pairs).join(X.maxsim(pairs, chunks, cosines), PAIR)
    columns = [*PAIR, "bm25", "semantic", "rrf", "place"]
    shortlist = X.shortlist(X.rrf(scores), settings.shortlist_size, picks).select(*columns)
    if stranded.limit(1).count():
        shortlist = shortlist.unionByName(X.pool_shortlist(stranded, docs, query, chunks, lines, settings.shortlist_size).select(*columns))
    shortlist = cut_lineage(shortlist)

    # Requirements and judgments
    wanted = pool.join(shortlist.select("job_id").distinct(), "job_id", "left_semi")
    requirements = cut_lineage(P.extract_requirements(wanted, aliases, None, settings.must_limit, settings.requirement_limit))
    facts = P.posting_facts(wanted, requirements)
    req_mentions = cut_lineage(M.tag_mentions(requirements.select("job_id", "req_no", "text"), ["job_id", "req_no"], "text", aliases))
    index = cut_lineage(J.skill_index(unit_mentions, units))
    if verdicts is None:
        req_skills = J.requirement_skills(requirements, req_mentions, skills)
        skill_rows = J.judge_skills(shortlist, req_skills, index, closure, related, units)
        free = J.free_text_requirements(requirements)
        if vectors is None:
            closest = J.closest_units(shortlist, free, units, _unit_skills(units, unit_mentions))
        else:
            closest = J.closest_by_vector(shortlist, free, units, *vectors)
        education = J.education_judgments(
            shortlist, J.education_requirements(requirements), units.where("section = 'education'"), profiles, J.study_field_table(spark) if study_fields is None else study_fields
        )
        judgments = J.judge(shortlist, requirements, skill_rows, J.candidate_facts(profiles, units), closest, "tfidf" if vectors is None else "dense", education)
        judgments = judgments.withColumn("downgraded", F.lit(False))
    else:
        owned = M.implied_skills(index.select("cv_id", "skill"), "cv_id", closure)
        asked = shortlist.select(*PAIR).join(requirements.select("job_id", "req_no", "kind", "skills"), "job_id")
        judgments = J.evidence_guard(verdicts, asked, units, owned)
    judgments = cut_lineage(judgments)

    # Ranking
    analyses = S.coverage(judgments).join(shortlist.select(*PAIR, F.col("rrf").alias("retrieval_score")), PAIR)
    ranked = cut_lineage(S.rank_analyses(analyses))
    flags = S.flags(shortlist, postings, facts, profiles, prefs)
    learn = S.top_learn(S.learn_next(judgments, ranked))

    # Tailoring
    selected = cut_lineage(S.select_jobs(ranked, None, settings.jobs_to_tailor))
    terms = cut_lineage(
        L.posting_terms(
            req_mentions.select("job_id", (F.col("req_no").cast("long") * (1 << 31) + F.col("pos")).alias("at"), "skill", "surface", "key", "member"),
            posting_mentions.select("job_id", F.col("pos").cast("long").alias("at"), "skill", "surface", "key", "member"),
        )
    )
    unit_skill_rows = unit_mentions.select("cv_id", "unit_no", "skill").distinct()
    aligned = cut_lineage(L.alignments(unit_mentions, terms, selected))
    title_skills = M.tag_mentions(wanted.select("job_id", "title"), ["job_id"], "title", aliases).select("job_id", "skill")
    bullets = L.pick_bullets(
        selected, units, unit_skill_rows, requirements, judgments, terms, title_skills, aligned, closure, settings.bullets_per_job
    )
    safe = cut_lineage(L.draft_aligned(bullets, aligned))
    naive = L.draft_stuffed(safe, judgments, unit_skill_rows, skills, closure)
    keys = [*PAIR, "unit_no", "attempt"]
    drafts = naive.withColumn("attempt", F.lit(1)).select(*keys, "original", "draft")
    for attempt in range(2, L.MAX_ATTEMPTS + 1):
        drafts = drafts.unionByName(safe.withColumn("attempt", F.lit(attempt)).select(*keys, "original", "draft"))
    checked = cut_lineage(L.draft_problems(drafts, keys, aliases, closure))
    tailored = cut_lineage(L.verify_drafts(checked, [*PAIR, "unit_no"]))
    # Drafts after the accepted one were never needed.
    made = checked.join(tailored.select(*PAIR, "unit_no", "attempts"), [*PAIR, "unit_no"]).where("attempt <= attempts").drop("attempts")

    reports = match_report(profiles, ranked, postings, requirements, judgments, units, flags, learn, tailored, made)
    return MatchRun(
        {
            "rejects": rejects, "units": units, "profiles": profiles, "search": search, "triaged": triaged, "scores": scores,
            "shortlist": shortlist, "requirements": requirements, "facts": facts, "judgments": judgments, "ranked": ranked,
            "flags": flags, "learn": learn, "selected": selected, "bullets": bullets, "checked": made, "tailored": tailored,
            "reports": reports, "aliases": aliases, "closure": closure,
        }
    )


def _by_family() -> WindowSpec:
    return W.partitionBy("cv_id").orderBy(F.desc("score"), F.asc("family_no"))


def _skill_lists(mentions: DataFrame, keys: list[str]) -> DataFrame:
    return mentions.groupBy(*keys).agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def _chunk_terms(postings: DataFrame, aliases: DataFrame, limit: int | None = None) -> DataFrame:
    """(job_id, chunk_no, terms): the title as chunk 0, then the content lines."""
    title = postings.select("job_id", F.lit(0).alias("chunk_no"), F.col("title").alias("text"))
    rows = cut_lineage(title.unionByName(P.content_chunks(postings, limit)))
    skills = _skill_lists(M.tag_mentions(rows, ["job_id", "chunk_no"], "text", aliases), ["job_id", "chunk_no"])
    none = F.array().cast("array<string>")
    x = rows.join(skills, ["job_id", "chunk_no"], "left")
    return cut_lineage(x.select("job_id", "chunk_no", X.line_terms(F.col("text"), F.coalesce("skills", none)).alias("terms")))


def _unit_skills(units: DataFrame, unit_mentions: DataFrame) -> DataFrame:
    return _skill_lists(unit_mentions, ["cv_id", "unit_no"])


def _unit_terms(units: DataFrame, unit_mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cv_id, unit_no, terms) of the lines with their role line; the headline stands in for a candidate without
    lines outside the languages section."""
    pool = units.where("section <> 'languages'").select("cv_id", "unit_no", F.trim(F.concat_ws(" ", "context", "text")).alias("line"))
    bare = profiles.join(pool.select("cv_id").distinct(), "cv_id", "left_anti").select(
        "cv_id", F.lit(0).alias("unit_no"), F.coalesce(F.nullif("headline", F.lit("")), F.lit("candidate")).alias("line")
    )
    x = pool.unionByName(bare).join(_unit_skills(units, unit_mentions), ["cv_id", "unit_no"], "left")
    none = F.array().cast("array<string>")
    return cut_lineage(x.select("cv_id", "unit_no", X.line_terms(F.col("line"), F.coalesce("skills", none)).alias("terms")))
