"""Fit, flags, rank, and what to learn next."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import rank_all, spread_by, top_k
from ..functions import text as T

MUST_WEIGHT = 0.75
LEARN_LIMIT = 12
PAIR = ["cv_id", "job_id"]

# Region dictionary and region wording.
REGIONS = {
    "tunisia": ["tunisia", "tunisie", "africa", "emea", "mena", "north africa", "maghreb"],
    "tunisie": ["tunisia", "tunisie", "africa", "emea", "mena", "north africa", "maghreb"],
    "tunis": ["tunisia", "tunisie", "africa", "emea", "mena", "north africa", "maghreb"],
    "sfax": ["tunisia", "tunisie", "africa", "emea", "mena"],
    "sousse": ["tunisia", "tunisie", "africa", "emea", "mena"],
    "france": ["france", "eu", "europe", "emea", "european union"],
    "paris": ["france", "eu", "europe", "emea"],
    "lyon": ["france", "eu", "europe", "emea"],
    "germany": ["germany", "deutschland", "eu", "europe", "emea", "dach"],
    "berlin": ["germany", "deutschland", "eu", "europe", "emea", "dach"],
    "morocco": ["morocco", "maroc", "africa", "emea", "mena"],
    "canada": ["canada", "north america", "americas"],
    "uk": ["uk", "united kingdom", "europe", "emea"],
    "london": ["uk", "united kingdom", "europe", "emea"],
}
OPEN_WORLD = r"\b(worldwide|anywhere|global|international|any location|all locations)\b"
REGION_WORDS = (
    r"\b(us|usa|u\.s\.|united states|north america|americas|canada|uk|united kingdom|eu|europe|emea|latam|apac|asia|"
    r"germany|france|spain|portugal|netherlands|poland|india|brazil|mexico|africa|mena)\b"
)
LEVEL_ORDER = {"student": 0, "intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4}
WRITTEN_IN = {"de": "German", "fr": "French"}


def half_points(v: Column) -> Column:
    """Verdict value in half points (met 2, partial 1), so sums stay whole numbers."""
    return F.when(v == "met", 2).when(v == "partial", 1).otherwise(0)


def fit_of(must: Column, n_must: Column, nice: Column, n_nice: Column) -> Column:
    """Fit with four decimals from sums of half points and counts: weighted when both kinds exist, else the one
    that does, else 0. Rounded half up on whole numbers, so the result does not depend on the order of sums."""
    heavy, light = round(5_000 * MUST_WEIGHT), round(5_000 * (1 - MUST_WEIGHT))
    top = (
        F.when((n_must > 0) & (n_nice > 0), heavy * must * n_nice + light * nice * n_must)
        .when(n_must > 0, 5_000 * must)
        .when(n_nice > 0, 5_000 * nice)
        .otherwise(0)
    )
    bottom = F.greatest(n_must, F.lit(1)) * F.greatest(n_nice, F.lit(1))
    return F.floor((2 * top + bottom) / (2 * bottom)) / 10_000


def _kind_sums(judgments: DataFrame, keys: list[str]) -> DataFrame:
    v = half_points(F.col("verdict"))
    must, nice = F.col("kind") == "must", F.col("kind") == "nice"
    return judgments.groupBy(*keys).agg(
        F.sum(F.when(must, v).otherwise(0)).alias("must_sum"), F.count_if(must).alias("n_must"),
        F.sum(F.when(nice, v).otherwise(0)).alias("nice_sum"), F.count_if(nice).alias("n_nice"),
    )


def coverage(judgments: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """(keys, must_coverage, nice_coverage, fit) from rows with ``kind`` and ``verdict``."""
    m, n, k, j = (F.col(c) for c in ("must_sum", "n_must", "nice_sum", "n_nice"))
    return _kind_sums(judgments, keys).select(
        *keys,
        F.when(n > 0, m / (2 * n)).alias("must_coverage"),
        F.when(j > 0, k / (2 * j)).alias("nice_coverage"),
        fit_of(m, n, k, j).alias("fit"),
    )


def rank_analyses(analyses: DataFrame, score: str = "retrieval_score") -> DataFrame:
    """``rank`` per candidate: fit, then retrieval score, then id. Groups may be of any size."""
    return rank_all(analyses, ["cv_id"], [F.desc("fit"), F.desc(score), F.asc("job_id")], "rank")


def verdict_counts(judgments: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Met, partial and missing per key and kind, with a row for all kinds together."""
    v = F.col("verdict")
    sums = [F.sum("n").alias("total")] + [F.sum(name).alias(name) for name in ("met", "partial", "missing")]
    per_kind = judgments.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(v == name).alias(name) for name in ("met", "partial", "missing")]
    )
    both = per_kind.withColumn("kind", F.explode(F.array("kind", F.lit("all"))))
    return both.groupBy(*keys, "kind").agg(*sums)


def skill_demand(cv_skills: DataFrame, job_skills: DataFrame) -> DataFrame:
    """(cv_id, skill, n_jobs): how many of the candidate's ranked postings ask for each of its skills.

    ``cv_skills(cv_id, skill)``, ``job_skills(cv_id, job_id, skill)``.
    """
    asked = job_skills.groupBy("cv_id", "skill").agg(F.countDistinct("job_id").alias("n_jobs"))
    return cv_skills.distinct().join(asked, ["cv_id", "skill"], "left").withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)))


def fit_band(fit: Column) -> Column:
    return F.when(fit >= 0.75, "high").when(fit >= 0.5, "mid").otherwise("low")


def fit_bands(analyses: DataFrame, by: list[str]) -> DataFrame:
    return analyses.groupBy(*by, fit_band(F.col("fit")).alias("band")).agg(F.count(F.lit(1)).alias("n_jobs"))


# --- Learn next ----------------------------------------------------------------------------------------------------
def learn_next(judgments: DataFrame, analyses: DataFrame, rows: int = 0) -> DataFrame:
    """(cv_id, skill, jobs_requiring, must_count, unlocks, fit_gain, job_ids) for every missing skill; ``job_ids`` are the
    candidate's analysed postings that ask for it, in order.

    ``judgments(cv_id, job_id, req_no, kind, verdict, missing_skills)``. Learning a skill turns a judgment to met
    when nothing else is missing in it, and missing to partial otherwise. The new coverage of a pair is its old
    sums plus the change, so only the judgments that lack the skill are touched: rows are exploded once and
    summed twice, and nothing is joined back to the full judgment table. ``rows``, the number of judgments if it is known, sets the number of tasks.
    """
    judgments = spread_by(judgments, rows, *PAIR)
    v = half_points(F.col("verdict"))
    is_must = F.col("kind") == "must"
    after = F.when(F.size("missing_skills") == 1, 2).when(F.col("verdict") == "missing", 1).otherwise(v)
    gaps = judgments.where("verdict <> 'met'").withColumn("missing_skills", F.array_distinct("missing_skills"))
    change = (
        gaps.withColumn("delta", after - v)
        .select(*PAIR, "kind", "delta", F.explode("missing_skills").alias("skill"))
        .groupBy(*PAIR, "skill")
        .agg(
            F.sum(F.when(is_must, F.col("delta")).otherwise(0)).alias("d_must"),
            F.sum(F.when(is_must, 0).otherwise(F.col("delta"))).alias("d_nice"),
            F.bool_or(is_must).alias("asked_as_must"),
        )
    )
    x = change.join(_kind_sums(judgments, PAIR), PAIR).join(analyses.select(*PAIR, "fit"), PAIR)
    must, nice = F.col("must_sum") + F.col("d_must"), F.col("nice_sum") + F.col("d_nice")
    full = 2 * F.col("n_must")
    new_fit = fit_of(must, F.col("n_must"), nice, F.col("n_nice"))
    x = x.withColumn("opened", (F.col("must_sum") < full) & (must == full)).withColumn("gain", F.greatest(F.lit(0.0), new_fit - F.col("fit")))
    # Gains have four decimals; their mean is rounded half up on whole numbers, so ties do not depend on the order
    # in which partial sums arrive.
    n, total = F.count(F.lit(1)), F.sum(F.round(F.col("gain") * 10_000).cast("long"))
    return spread_by(x, rows, "cv_id").groupBy("cv_id", "skill").agg(
        n.alias("jobs_requiring"),
        F.count_if("asked_as_must").alias("must_count"),
        F.count_if("opened").alias("unlocks"),
        (F.floor((2 * total + n) / (2 * n)) / 10_000).alias("fit_gain"),
        F.array_sort(F.collect_set("job_id")).alias("job_ids"),
    )


def top_learn(items: DataFrame, limit: int = LEARN_LIMIT) -> DataFrame:
    order = [F.desc("unlocks"), F.desc("must_count"), F.desc("jobs_requiring"), F.desc("fit_gain"), F.asc("skill")]
    return top_k(items, ["cv_id"], order, limit, "place")


# --- Flags ---------------------------------------------------------------------------------------------------------
def _regions_of(folded: Column) -> Column:
    found = [F.when(folded.contains(key), F.array(*[F.lit(r) for r in [*names, key]])) for key, names in REGIONS.items()]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))


def _place_tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def _short(c: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")


def flags(pairs: DataFrame, postings: DataFrame, facts: DataFrame, profiles: DataFrame, prefs: DataFrame | None = None) -> DataFrame:
    """(cv_id, job_id, seq, flag, message): location, language and seniority warnings of each pair.

    ``facts`` is ``posting_facts`` output; ``prefs(cv_id, location)`` overrides the profile's place.
    """
    p = profiles.select("cv_id", F.col("location").alias("own_place"), "years_experience", F.col("seniority").alias("own_level"), F.col("languages").alias("levels"))
    if prefs is not None:
        p = p.join(prefs.select("cv_id", F.nullif("location", F.lit("")).alias("pref")), "cv_id", "left")
    else:
        p = p.withColumn("pref", F.lit(None).cast("string"))
    p = p.withColumn("user_loc", T.fold(F.coalesce("pref", "own_place", F.lit("")))).withColumn("user_regions", _regions_of(F.col("user_loc")))
    j = facts.join(postings.select("job_id", "location", F.col("workplace").alias("posted_workplace")), "job_id")
    x = pairs.select(*PAIR).distinct().join(j, "job_id").join(p, "cv_id")
    loc = T.fold(F.coalesce("location", F.lit("")))
    place = F.when(F.col("workplace") != "unknown", F.col("workplace")).otherwise(F.col("posted_workplace"))
    named = F.array_distinct(F.regexp_extract_all(loc, F.lit(REGION_WORDS), F.lit(1)))
    limited = (
        (place == "remote") & (F.size(named) > 0) & ~loc.rlike(OPEN_WORLD) & (F.size("user_regions") > 0)
        & ~F.arrays_overlap(named, F.col("user_regions"))
    )
    elsewhere = (
        (place != "remote") & (F.col("user_loc") != "") & (loc != "")
        & (F.size(F.array_intersect(_place_tokens(F.col("user_loc")), _place_tokens(loc))) == 0)
        & (F.size(F.array_intersect(F.col("user_regions"), _place_tokens(loc))) == 0)
    )

    def flag(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("flag"), message.alias("message"))

    location = F.when(limited, flag("location", F.concat(F.lit("Remote, but limited to "), "location"))).when(
        elsewhere,
        flag("location", F.concat(F.when(place == "hybrid", "Hybrid").otherwise("On-site"), F.lit(" in "), F.col("location"))),
    )
    known = lambda l: F.coalesce(F.element_at("levels", l), F.lit(0))
    asked = F.transform(F.filter("languages", lambda l: known(l) < 3), lambda l: flag("language", F.concat(F.lit("Asks for "), l)))
    written = F
    for code, name in WRITTEN_IN.items():
        written = written.when(F.col("posting_language") == code, F.lit(name))
    implicit = F.when(
        written.isNotNull() & (known(written) < 3) & ~F.array_contains("languages", written),
        flag("language", F.concat(F.lit("Posting is written in "), written)),
    )

    def level(c: str) -> Column:
        out = F
        for name, n in LEVEL_ORDER.items():
            out = out.when(F.col(c) == name, F.lit(n))
        return out

    need, have = level("seniority"), F.coalesce(level("own_level"), F.lit(1))
    years = F.when(F.col("years_experience") < 0.5, "less than a year").otherwise(F.concat(F.lit("about "), _short(F.col("years_experience"))))
    seniority = (
        F.when(
            need - have >= 2,
            flag("seniority", F.concat(F.initcap("seniority"), F.lit("-level role; your CV reads "), "own_level")),
        )
        .when(
            F.col("min_years") > F.col("years_experience") + 1.5,
            flag("seniority", F.concat(F.lit("Asks "), _short(F.col("min_years")), F.lit("+ years; your CV shows "), years)),
        )
        .when(
            (F.col("seniority") == "intern") & (have >= 2), flag("seniority", F.lit("Internship; your CV reads more experienced"))
        )
    )
    every = F.array_compact(F.concat(F.array(location), asked, F.array(implicit), F.array(seniority)))
    return x.select(*PAIR, F.posexplode(every).alias("at", "f")).select(*PAIR, (F.col("at") + 1).alias("seq"), "f.flag", "f.message")


# --- Wide view -----------------------------------------------------------------------------------------------------
def ranked_view(ranked: DataFrame, postings: DataFrame, shortlist: DataFrame, triage: DataFrame, chars: int = 6000) -> DataFrame:
    """Ranked analyses with the posting's fields, the retrieval scores and the triage reason. ``chars`` bounds the
    description preview that is shown with a row."""
    scores = shortlist.select(*PAIR, *[c for c in ("bm25", "semantic", "rrf") if c in shortlist.columns])
    return (
        ranked.join(
            postings.select("job_id", "title", "company", "location", "url", "attribution", F.substring("description", 1, chars).alias("description")),
            "job_id", "left",
        )
        .join(scores, PAIR, "left")
        .join(triage.select(*PAIR, "reason"), PAIR, "left")
    )


def select_jobs(ranked: DataFrame, picks: DataFrame | None = None, auto: int | None = None, limit: int = 3) -> DataFrame:
    """(cv_id, job_id, rank) chosen for tailoring: the picks that are ranked, in pick order, or the best ``auto``."""
    if picks is None:
        return ranked.where(F.col("rank") <= min(auto or limit, limit)).select(*PAIR, "rank")
    order = [F.asc("pick_no")] if "pick_no" in picks.columns else [F.asc("rank")]
    chosen = picks.join(ranked.select(*PAIR, "rank"), PAIR)
    return top_k(chosen, ["cv_id"], order, limit, "place").select(*PAIR, "rank")
