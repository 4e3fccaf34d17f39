"""Which postings a candidate should look at: title matches, shared skills, wider search."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import TASK_ROWS, checked_broadcast, cut_lineage, explode_once, first_absent, is_small, rank_all, shuffle_tasks, spread_by, spread_hot_keys, stage_table, top_k
from ..functions import roles as R
from ..functions import text as T

TOP_SKILLS = 30  # the limit a user may ask for
QUERY_LIMIT, WIDE_QUERY_LIMIT, PER_ROUND = 5, 12, 4


def match_titles(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(job_id, query) for every query whose meaningful words all occur in the title.

    A query is joined through its rarest word only and its other words are checked on the joined row, so a
    word that sits in a third of the titles produces no rows unless it is all a query has.
    """
    titles = postings.select("job_id", R.title_keys(F.col("title")).alias("have")).select("job_id", "have", F.explode("have").alias("k"))
    asked = queries.select("query").distinct().select("query", R.query_keys(F.col("query")).alias("need")).where("size(need) > 0")
    words = asked.select(F.explode("need").alias("k")).distinct()
    counts = titles.join(checked_broadcast(words), "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asked.select("query", "need", F.explode("need").alias("k"))
        .join(counts, "k", "left")
        .groupBy("query", "need")
        .agg(F.min_by("k", F.struct(F.coalesce("n", F.lit(0)), "k")).alias("k"))
    )
    return (
        titles.join(checked_broadcast(rarest), "k")
        .where(F.size(F.array_except("need", "have")) == 0)
        .select("job_id", "query")
    )


def first_title_match(cv_queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(cv_id, job_id, query, pos): the first of the candidate's queries that matches each title."""
    return (
        match_titles(cv_queries, postings)
        .join(cv_queries, "query")
        .groupBy("cv_id", "job_id")
        .agg(F.min("pos").alias("pos"), F.min_by("query", "pos").alias("query"))
    )


def overlap_threshold(n_skills: Column) -> Column:
    return F.when(n_skills >= 12, 4).otherwise(3)


#: A document of more skills than this is compared row by row, by which it spreads over many tasks.
LONG_LIST = 1000


def shared_skills(cv_skills: DataFrame, job_skills: DataFrame, threshold=overlap_threshold) -> DataFrame:
    """(cv_id, job_id, n_overlap, shared) for pairs with at least ``threshold(n)`` common skills.

    Both inputs are one row per owner with a ``skills`` array. A candidate's skills are ordered by rarity; who shares m of n
    skills shares one of the n - m + 1 rarest, so a pair is only looked at if it shares one of these. ``job_skills`` is read once; of it (owner, skill) rows that a
    candidate asks for are kept. These are shuffled once, by posting, over tasks in proportion to their number: its pairs are found, and compared with its list of skills, where it is. Only
    postings with more than ``LONG_LIST`` skills meet their pairs as rows dealt out by posting and skill.
    """
    cv_rows = cv_skills.select("cv_id", F.explode(F.array_distinct("skills")).alias("skill"))
    known = cut_lineage(cv_rows.select("skill").where("skill is not null").distinct())
    held = job_skills.select("job_id", F.explode(F.array_distinct("skills")).alias("skill")).where("job_id is not null and skill is not null")
    held = stage_table(held.join(F.broadcast(known), "skill", "left_semi").select("job_id", "skill") if is_small(known) else held)
    counts = cut_lineage(held.join(checked_broadcast(known), "skill", "left_semi").groupBy("skill").agg(F.count(F.lit(1)).alias("n")))
    cv = (
        cv_rows.join(counts, "skill", "left")
        .groupBy("cv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "skill"))).alias("s"))
        .select("cv_id", F.transform("s", lambda x: x["skill"]).alias("cv_set"))
    )
    cv = cut_lineage(cv.withColumn("need", threshold(F.size("cv_set"))).where((F.size("cv_set") >= F.col("need")) & F.col("cv_id").isNotNull()))
    rare = cv.select("cv_id", F.explode(F.slice("cv_set", F.lit(1), F.size("cv_set") - F.col("need") + 1)).alias("skill"))
    hits = _total(rare.join(counts, "skill"), "n")
    n = max(shuffle_tasks(held), -(-max(_total(counts, "n"), hits) // TASK_ROWS))
    own = held.repartition(n, "job_id")
    lists = own.groupBy("job_id").agg(F.collect_list("skill").alias("held"))
    if is_small(rare):
        met = own.join(F.broadcast(rare), "skill").select("cv_id", "job_id")
    else:
        met = skewed_join(held, rare, ["skill"]).select("cv_id", "job_id").repartition(n, "job_id")
    met = met.distinct()
    short = lists.where(F.size("held") <= LONG_LIST).withColumn("twice", F.size(F.array_distinct("held")) < F.size("held"))
    sets = cv.withColumn("cv_twice", F.size(F.array_distinct("cv_set")) < F.size("cv_set"))
    both = met.join(short, "job_id")
    both = both.join(F.broadcast(sets), "cv_id") if is_small(sets) else skewed_join(both.select("cv_id", "job_id"), sets, ["cv_id"]).repartition(n, "job_id").join(short, "job_id")
    times = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    # an owner of two rows counts with both
    every = lambda common: F.flatten(F.transform(common, lambda s: F.array_repeat(s, times(F.col("held"), s) * times(F.col("cv_set"), s))))
    common = F.array_intersect("held", "cv_set")
    listed = both.select("cv_id", "job_id", "need", explode_once(F.array(F.when(F.col("twice") | F.col("cv_twice"), every(common)).otherwise(common))).alias("shared"))
    shared = listed.unionByName(_shared_rows(held, met, cv, hits)).where(F.size("shared") >= F.col("need"))
    return shared.select("cv_id", "job_id", F.size("shared").alias("n_overlap"), F.sort_array("shared").alias("shared"))


def _shared_rows(held: DataFrame, met: DataFrame, cv: DataFrame, hits: int) -> DataFrame:
    """(cv_id, job_id, need, shared) of the pairs ``met`` of postings with long lists, counted on (owner, skill) rows."""
    long = cut_lineage(held.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_LIST))
    n, most = long.count(), cv.agg(F.max(F.size("cv_set"))).first()[0] or 0
    rows = max(_total(long, "n"), min(hits, n * cv.count()) * most)
    ids = checked_broadcast(long.select("job_id")) if n else long.select("job_id").limit(0)  # which no task is planned for
    asked = skewed_join(met.join(ids, "job_id", "left_semi"), cv.select("cv_id", "need", F.explode("cv_set").alias("skill")), ["cv_id"])
    found = spread_by(asked, rows, "job_id", "skill").join(spread_by(held.join(ids, "job_id", "left_semi"), rows, "job_id", "skill"), ["job_id", "skill"])
    return spread_by(found, rows, "cv_id", "job_id").groupBy("cv_id", "job_id", "need").agg(F.collect_list("skill").alias("shared"))


def _total(df: DataFrame, n: str) -> int:
    return df.agg(F.sum(n)).first()[0] or 0


def skewed_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Inner join that broadcasts ``other`` when it is small and slices hot keys of ``big`` when it is not."""
    if is_small(other):
        return big.join(F.broadcast(other), keys, how)
    a, b, on = spread_hot_keys(big, other, keys)
    return a.join(b, on, how).drop("__slice")


def plan_queries(profiles: DataFrame, family_scores: DataFrame, families: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(cv_id, queries): the candidate's own keywords, then the titles of the best family and of the second when
    it reaches 60% of the first; target titles when no family scores; at most five."""
    ranked = (
        top_k(family_scores.where("score > 0"), ["cv_id"], [F.desc("score"), F.asc("family_no")], 2, "place")
        .join(checked_broadcast(families.select("family", "titles")), "family")
        .groupBy("cv_id")
        .agg(
            F.max_by("titles", -F.col("place")).alias("first"),
            F.max("score").alias("top"),
            F.max(F.when(F.col("place") == 2, F.struct("score", "titles"))).alias("second"),
        )
    )
    none = F.array().cast("array<string>")
    second = F.when(F.col("second.score") >= 0.6 * F.col("top"), F.col("second.titles")).otherwise(none)
    out = profiles.select("cv_id", "target_titles").join(ranked, "cv_id", "left")
    if keywords is not None:
        out = out.join(keywords.select("cv_id", "keywords"), "cv_id", "left")
    else:
        out = out.withColumn("keywords", none)
    titles = F.coalesce(F.concat("first", second), "target_titles", none)
    return out.select(
        "cv_id", F.slice(F.array_distinct(F.concat(F.coalesce("keywords", none), titles)), 1, QUERY_LIMIT).alias("queries")
    )


def widen_rounds(plans: DataFrame) -> DataFrame:
    """(cv_id, round, pos, query) of the first search and two wider rounds.

    ``plans(cv_id, queries, titles)``: ``titles`` are the titles and synonyms of the candidate's best families in
    order. Round r adds four titles not asked before; round two takes places five to eight of the remaining
    list, or its first four when there are no more.
    """
    def unused(asked: Column) -> Column:
        low = F.transform(asked, F.lower)
        return F.array_distinct(F.filter("titles", lambda t: ~F.array_contains(low, F.lower(t))))

    p = plans.withColumn("q0", F.col("queries"))
    p = p.withColumn("new1", F.slice(unused(F.col("q0")), 1, PER_ROUND))
    p = p.withColumn("q1", F.slice(F.array_distinct(F.concat("q0", "new1")), 1, WIDE_QUERY_LIMIT))
    p = p.withColumn("left2", unused(F.col("q1")))
    p = p.withColumn(
        "new2",
        F.when(F.size("left2") > PER_ROUND, F.slice("left2", PER_ROUND + 1, PER_ROUND)).otherwise(F.slice("left2", 1, PER_ROUND)),
    )
    p = p.withColumn("q2", F.slice(F.array_distinct(F.concat("q1", "new2")), 1, WIDE_QUERY_LIMIT))
    rows = p.select("cv_id", F.posexplode("q2").alias("at", "query"), "q0", "q1")
    first_round = F.when(F.array_contains("q0", F.col("query")), 0).when(F.array_contains("q1", F.col("query")), 1).otherwise(2)
    return rows.select("cv_id", first_round.alias("round"), (F.col("at") + 1).alias("pos"), "query")


def widen_search(
    plans: DataFrame, postings: DataFrame, overlaps: DataFrame | None = None, min_relevant: int = 15, pool_size: int | None = None
) -> DataFrame:
    """(cv_id, round, n_relevant, target, queries): the first round that finds enough postings, else the last.

    All rounds are matched in one pass; a posting counts from the first round in which it is relevant.
    """
    rounds = widen_rounds(plans)
    matched = match_titles(rounds, postings).join(rounds.select("cv_id", "round", "query"), "query").select("cv_id", "job_id", "round")
    if overlaps is not None:
        matched = matched.unionByName(overlaps.select("cv_id", "job_id", F.lit(0).alias("round")))
    per_cv = (
        matched.groupBy("cv_id", "job_id")
        .agg(F.min("round").alias("round"))
        .groupBy("cv_id")
        .agg(*[F.count_if(F.col("round") <= r).alias(f"n{r}") for r in (0, 1, 2)])
    )
    pool = F.lit(pool_size) if pool_size is not None else postings.agg(F.count(F.lit(1))).scalar()
    target = F.greatest(F.lit(1), F.least(F.lit(min_relevant), pool))
    asked = rounds.groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "round", "query"))).alias("all"))
    out = plans.select("cv_id").join(per_cv, "cv_id", "left").join(asked, "cv_id", "left").withColumn("target", target)
    n = [F.coalesce(f"n{r}", F.lit(0)) for r in (0, 1, 2)]
    stop = F.when(n[0] >= F.col("target"), 0).when(n[1] >= F.col("target"), 1).otherwise(2)
    return out.withColumn("round", stop).select(
        "cv_id",
        "round",
        F.when(F.col("round") == 0, n[0]).when(F.col("round") == 1, n[1]).otherwise(n[2]).alias("n_relevant"),
        "target",
        F.transform(F.filter("all", lambda q: q["round"] <= F.col("round")), lambda q: q["query"]).alias("queries"),
    )


def triage(
    cv_queries: DataFrame,
    postings: DataFrame,
    cv_skills: DataFrame,
    job_skills: DataFrame,
    picked_sources: tuple[str, ...] = (),
    cv_picks: DataFrame | None = None,
    top_skills: int | None = None,
) -> DataFrame:
    """(cv_id, job_id, reason, query, n_overlap) of the relevant pairs; a title match takes precedence.

    ``cv_picks`` (cv_id, job_id) are postings the candidate chose; with ``picked_sources`` they skip the tests. ``top_skills`` keeps the first skills of a candidate only.
    """
    by_title = first_title_match(cv_queries, postings).select("cv_id", "job_id", "query")
    top = cv_skills.select("cv_id", F.slice("skills", 1, top_skills).alias("skills")) if top_skills else cv_skills.select("cv_id", "skills")
    by_skill = shared_skills(top, job_skills)
    both = by_title.join(by_skill, ["cv_id", "job_id"], "full_outer")
    reason = F.when(F.col("query").isNotNull(), F.concat(F.lit("title matches '"), "query", F.lit("'"))).otherwise(
        F.concat(F.col("n_overlap").cast("string"), F.lit(" shared skills ("), F.array_join(F.slice("shared", 1, 3), ", "), F.lit(")"))
    )
    out = both.select("cv_id", "job_id", reason.alias("reason"), "query", "n_overlap")
    if cv_picks is not None:
        chosen = postings.where(F.col("source").isin(*picked_sources)) if picked_sources else postings
        own = cv_picks.join(chosen.select("job_id"), "job_id", "left_semi").select("cv_id", "job_id").distinct()
        out = out.join(own, ["cv_id", "job_id"], "left_anti").unionByName(
            own.select("*", F.lit("picked by you").alias("reason"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("n_overlap"))
        )
    return out


def triage_summary(cvs: DataFrame, triaged: DataFrame, pool_size: Column, min_relevant: int = 15) -> DataFrame:
    """(cv_id, relevant, total, by_title, by_skills, target) of every candidate, those without a relevant posting included."""
    counted = triaged.groupBy("cv_id").agg(
        F.count(F.lit(1)).alias("relevant"),
        F.count_if(F.col("query").isNotNull()).alias("by_title"),
        F.count_if(F.col("query").isNull()).alias("by_skills"),
    )
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return cvs.select("cv_id").distinct().join(counted, "cv_id", "left").select(
        "cv_id", n("relevant"), pool_size.cast("long").alias("total"), n("by_title"), n("by_skills"),
        F.greatest(F.lit(1), F.least(F.lit(min_relevant), pool_size)).cast("int").alias("target"),
    )


def candidates_without_match(cvs: DataFrame, triaged: DataFrame) -> DataFrame:
    """Candidates with no relevant posting. Their shortlist comes from the whole pool through the term index."""
    return cvs.select("cv_id").join(triaged.select("cv_id").distinct(), "cv_id", "left_anti")


def rejected_titles(cv_ids: DataFrame, triaged: DataFrame, postings: DataFrame, k: int = 40, order: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """First ``k`` postings in pool order (``order``) that are not relevant, per candidate, with their ``rank``.

    The first ``k`` places that a candidate's relevant postings leave free are found from their counts (``first_absent``), so a candidate asks for ``k`` places,
    however many relevant postings it has; places that many candidates ask for are sliced. Places in the pool are numbered over many tasks.
    """
    ordered = pool_places(postings, order, "title")
    relevant = triaged.select("cv_id", "job_id").distinct().join(ordered.select("job_id", "seq"), "job_id")
    present = rank_all(relevant, ["cv_id"], [F.col("seq")], "rank")
    asked = first_absent(cv_ids, present, "cv_id", k).select("cv_id", "seq", F.col("nth").alias("rank"))
    return skewed_join(asked, ordered, ["seq"]).select("cv_id", "job_id", "title", F.col("rank").cast("int").alias("rank"))


def pool_places(postings: DataFrame, order: tuple[str, ...] = ("job_id",), *carry: str) -> DataFrame:
    """(job_id, carry, seq): place of each posting in the pool, materialised."""
    pool = postings.select("job_id", *carry, *[c for c in order if c != "job_id"]).withColumn("__all", F.lit(0))
    return cut_lineage(rank_all(pool, ["__all"], [F.col(c) for c in order], "seq", window_rows=0).select("job_id", *carry, "seq"))
