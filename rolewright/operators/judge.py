"""Evidence judging: every requirement of a pair is met, partial or missing, with the lines that show it.

Rows are keyed by (cv_id, job_id, req_no) and, while skills are looked up, by the position of the skill in the
requirement. A requirement is one short line, so lists collected per requirement are small.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..cluster import checked_broadcast, cut_lineage, explode_once
from ..functions import text as T
from ..functions.vocab import PRODUCT_KINDS
from .languages import language_levels
from .mentions import implied_skills
from .postings import STUDENT_REQUIREMENT
from .retrieval import dot, line_cosines, line_terms, unit_vector

# Section order for citing, verdict ranks, similarity thresholds, study fields.
SECTION_ORDER = ["experience", "projects", "summary", "certifications", "other", "skills", "education", "languages"]
RANKS = {"missing": 0, "partial": 1, "met": 2}
THRESHOLDS = {"tfidf": (0.38, 0.22), "dense": (0.62, 0.48)}
ANY_OF = r"\b(or|ou|oder)\b"
STUDY_FIELDS = {
    "mechanical": ["mechanical", "mecanique", "maschinenbau"],
    "electromechanical": ["electromechanical", "electromecanique"],
    "industrial": ["industrial", "industriel", "industrielle"],
    "electrical": ["electrical", "electrique", "electrotechnique", "elektrotechnik"],
    "computer science": ["computer science", "informatique", "informatik", "software engineering"],
    "data science": ["data science", "science des donnees"],
    "statistics": ["statistic", "statistique", "statistik"],
    "mathematics": ["mathemat"],
    "physics": ["physics", "physique", "physik"],
    "chemical": ["chemical", "chimie", "chimique", "chemie"],
    "civil": ["civil engineering", "genie civil"],
    "energy": ["energy", "energie", "energetique"],
    "maintenance": ["maintenance"],
    "reliability": ["reliability", "fiabilite", "dependability", "surete de fonctionnement", "rams"],
    "aerospace": ["aerospace", "aeronautique", "aeronautic"],
    "accounting": ["accounting", "comptabilite"],
}
ENGINEERING = r"\b(engineering|engineer|ingenieurs?|genie|ingenieur)\b"
FILLER = (
    r"\b([0-9]+\+?|years?|yrs|ans|annees|jahre|of|in|a|an|the|de|d|en|minimum|at|least|experience|experiences|professional|"
    r"professionnelle|relevant|similar|role|roles|position|work|working|industry|field|domaine|poste|similaire|und|mit)\b"
)
FUNCTION_WORDS = ["de", "des", "du", "d", "la", "le", "les", "l", "of", "the", "a", "an", "and", "et", "en"]
PAIR = ["cv_id", "job_id"]
REQ = ["cv_id", "job_id", "req_no"]


def section_rank(section: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), section)
    return F.when(pos > 0, pos - 1).otherwise(9)


def verdict_rank(v: Column) -> Column:
    return F.when(v == "met", 2).when(v == "partial", 1).otherwise(0)


def rank_verdict(r: Column) -> Column:
    return F.when(r == 2, "met").when(r == 1, "partial").otherwise("missing")


def same_wording(cv: Column, jd: Column) -> Column:
    """The candidate's term covers the posting's, give or take articles, plurals or extra words. Not symmetric."""
    def key(c: Column) -> Column:
        return F.array_join(F.filter(F.split(T.fold(c), r"[\s\-']+"), lambda w: (w != "") & ~w.isin(*FUNCTION_WORDS)), "")

    def test(x: Column) -> Column:
        a, b = x["a"], x["b"]
        shorter = F.least(F.length(a), F.length(b))
        common = F.aggregate(
            F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n),
        )
        close = (F.abs(F.length(a) - F.length(b)) <= 1) & (common >= 0.75 * shorter)
        return (a != "") & (b != "") & ((a == b) | a.contains(b) | close)

    return T.bind(F.struct(key(cv).alias("a"), key(jd).alias("b")), test)


# --- Evidence index ----------------------------------------------------------------------------------------------
def skill_index(unit_mentions: DataFrame, units: DataFrame) -> DataFrame:
    """(cv_id, skill, ids, keys, key_ids, weak_only, plain, place): where each candidate shows each skill.

    ``unit_mentions`` are the mentions of the units' text keyed by (cv_id, unit_no). Units are cited by section
    order, then line order; ``ids`` holds the first two, ``plain`` the first wording that is not a member tool.
    """
    m = unit_mentions.join(units.select("cv_id", "unit_no", "unit_id", "section"), ["cv_id", "unit_no"]).withColumn(
        "place", section_rank(F.col("section"))
    )
    at = F.struct("place", "unit_no", "pos")
    # one shuffle: the units of a skill, and those of each of its keys, are sets of a row
    x = m.groupBy("cv_id", "skill").agg(
        F.bool_and("weak").alias("weak_only"),
        F.array_sort(F.collect_set("key")).alias("keys"),
        F.min_by(F.when(~F.col("member"), F.col("surface")), F.when(~F.col("member"), at)).alias("plain"),
        F.min(at).alias("first"),
        F.sort_array(F.collect_set(F.struct("key", "place", "unit_no", "unit_id"))).alias("by_key"),
    )
    two = lambda units: F.slice(F.transform(units, lambda u: u["unit_id"]), 1, 2)
    units_of = F.sort_array(F.array_distinct(F.transform("by_key", lambda u: F.struct(u["place"].alias("place"), u["unit_no"].alias("unit_no"), u["unit_id"].alias("unit_id")))))
    each_key = F.transform(F.array_distinct(F.transform("by_key", lambda u: u["key"])), lambda k: F.struct(k.alias("key"), two(F.filter("by_key", lambda u: u["key"] == k)).alias("u")))
    return x.where("cv_id is not null and skill is not null").select("cv_id", "skill", "weak_only", "keys", "plain", "first", two(units_of).alias("ids"), F.map_from_entries(each_key).alias("key_ids"))


def requirement_skills(requirements: DataFrame, mentions: DataFrame, skills: DataFrame) -> DataFrame:
    """(job_id, req_no, at, skill, known, specific, named, jd_keys, plain_jd): the skills of each requirement.

    ``mentions`` are keyed by (job_id, req_no). ``specific`` means the posting names a product of the skill
    ("DAX") and never the skill itself.
    """
    seen = mentions.groupBy("job_id", "req_no", "skill").agg(
        F.bool_and("member").alias("all_member"),
        F.min_by("surface", "pos").alias("named"),
        F.array_sort(F.collect_set("key")).alias("jd_keys"),
        F.min_by(F.when(~F.col("member"), F.col("surface")), F.when(~F.col("member"), F.col("pos"))).alias("plain_jd"),
    )
    kinds = skills.select("skill", "kind")
    r = requirements.select("job_id", "req_no", F.posexplode("skills").alias("at", "skill"))
    return (
        r.join(seen, ["job_id", "req_no", "skill"], "left")
        .join(checked_broadcast(kinds), "skill", "left")
        .select(
            "job_id", "req_no", "at", "skill",
            F.col("kind").isNotNull().alias("known"),
            (F.coalesce("all_member", F.lit(False)) & F.coalesce(F.col("kind").isin(*PRODUCT_KINDS), F.lit(False))).alias("specific"),
            "named",
            F.coalesce("jd_keys", F.array().cast("array<string>")).alias("jd_keys"),
            "plain_jd",
        )
    )


def judge_skills(
    pairs: DataFrame, req_skills: DataFrame, index: DataFrame, closure: DataFrame, related: DataFrame, units: DataFrame | None = None
) -> DataFrame:
    """(cv_id, job_id, req_no, at, skill, label, verdict, ids, note, cv_term, jd_term) per requirement skill.

    In order: shown directly (partial when the posting wants another product of the skill, or when the evidence
    is only indirect), implied by a shown skill, related to a shown skill (partial), an unknown term written
    literally in the candidate's lines, else missing.
    """
    shown = index.select(
        "cv_id", "skill", F.struct("ids", "keys", "key_ids", "weak_only", "plain").alias("own")
    )
    implied = implied_skills(index.select("cv_id", "skill"), "cv_id", closure).where("implied_by is not null")
    by_implied = implied.join(index.select("cv_id", F.col("skill").alias("implied_by"), "ids", "weak_only"), ["cv_id", "implied_by"]).select(
        "cv_id", "skill", F.struct("implied_by", "ids", "weak_only").alias("via")
    )
    near = (
        index.select("cv_id", F.col("skill").alias("other"), "ids", "first")
        .join(checked_broadcast(related), "other")
        .groupBy("cv_id", "skill")
        .agg(F.min_by(F.struct("other", "ids"), F.struct("first", "other")).alias("near"))
    )
    wanted = pairs.select(*PAIR).distinct().join(req_skills, "job_id")
    x = (
        wanted.join(shown, ["cv_id", "skill"], "left").join(by_implied, ["cv_id", "skill"], "left").join(near, ["cv_id", "skill"], "left")
    )
    if units is not None:
        # by candidate and skill, where the rows lie already: only a term that is not known looks at it
        unknown = req_skills.where("not known")
        x = x.join(_literal_units(_wanted_terms(pairs, unknown), unknown, units), ["cv_id", "skill"], "left")
    else:
        x = x.withColumn("literal", F.lit(None).cast("string"))
    own, via = F.col("own"), F.col("via")
    hit_keys = F.array_intersect("jd_keys", own["keys"])
    other_product = F.col("specific") & (F.size(hit_keys) == 0)
    has_own, has_via = own.isNotNull(), via.isNotNull()
    weak = F.when(has_own, own["weak_only"]).otherwise(F.coalesce(via["weak_only"], F.lit(False)))
    none = F.array().cast("array<string>")
    case = (
        F.when(has_own & other_product, "product")
        .when(~has_own & has_via & F.col("specific"), "product")
        .when((has_own | has_via) & weak, "indirect")
        .when(has_own, "own")
        .when(has_via, "implied")
        .when(F.col("known") & F.col("near").isNotNull(), "related")
        .when(~F.col("known") & F.col("literal").isNotNull(), "literal")
        .otherwise("missing")
    )
    x = x.withColumn("case", case)
    c = F.col("case")
    source_ids = F.when(has_own, own["ids"]).otherwise(via["ids"])
    exact = F.element_at(own["key_ids"], F.get(hit_keys, F.lit(0)))
    note = (
        F.when(c == "product", F.concat(F.lit("has "), "skill", F.lit(", not "), "named"))
        .when(c == "indirect", F.concat(F.lit("only indirect evidence for "), "skill"))
        .when(c == "implied", F.concat("skill", F.lit(" implied by "), via["implied_by"]))
        .when(c == "related", F.concat(F.lit("related: "), F.col("near.other")))
        .otherwise("")
    )
    worded = (
        (c == "own")
        & F.col("plain_jd").isNotNull()
        & own["plain"].isNotNull()
        & (F.size(hit_keys) == 0)
        & ~same_wording(own["plain"], F.col("plain_jd"))
    )
    return x.select(
        *REQ,
        "at",
        "skill",
        F.when(c == "product", F.col("named")).otherwise(F.col("skill")).alias("label"),
        F.when(c.isin("own", "implied", "literal"), "met").when(c == "missing", "missing").otherwise("partial").alias("verdict"),
        F.when(c.isin("product", "indirect", "implied"), source_ids)
        .when(c == "own", F.when(F.col("specific"), F.coalesce(exact, own["ids"])).otherwise(own["ids"]))
        .when(c == "related", F.col("near.ids"))
        .when(c == "literal", F.array("literal"))
        .otherwise(none)
        .alias("ids"),
        note.alias("note"),
        F.when(worded, own["plain"]).alias("cv_term"),
        F.when(worded, F.col("plain_jd")).alias("jd_term"),
    )


def literal_evidence(pairs: DataFrame, terms: DataFrame, units: DataFrame) -> DataFrame:
    """(cv_id, job_id, skill, literal): first unit whose text has the term as whole words.

    ``terms(job_id, skill)``. The lines are indexed once by their words and a term is looked up under its rarest one, so neither a common first word nor the number of postings
    that use a term matters: a candidate and a term meet once, and only lines that hold that word are fetched and confirmed.
    """
    wanted = _wanted_terms(pairs, terms)
    return wanted.join(_literal_units(wanted, terms, units), ["cv_id", "skill"]).select(*PAIR, "skill", "literal")


def _wanted_terms(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    return pairs.select(*PAIR).distinct().join(terms.select("job_id", "skill").distinct(), "job_id")


def _literal_units(wanted: DataFrame, terms: DataFrame, units: DataFrame) -> DataFrame:
    """(cv_id, skill, literal) of the ``terms`` that ``wanted(cv_id, job_id, skill)`` asks for."""
    word = rf"([{T.WORD_CHAR}]+)"
    words_of = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(word), F.lit(1)))
    folded = units.select("cv_id", "unit_no", "unit_id", T.fold(F.col("text")).alias("folded"))
    index = folded.select("cv_id", "unit_no", explode_once(words_of(F.col("folded"))).alias("w"))
    known = terms.select("skill").distinct().withColumn("need", words_of(T.fold(F.col("skill")))).where("size(need) > 0")
    known = known.select("skill", F.explode("need").alias("w"))
    asked_words = known.select("w").distinct()
    index = cut_lineage(index.join(checked_broadcast(asked_words), "w", "left_semi"))
    counts = index.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = known.join(counts, "w", "left").groupBy("skill").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    asked = wanted.select("cv_id", "skill").distinct().join(rarest, "skill")
    hits = asked.join(index, ["cv_id", "w"]).join(folded, ["cv_id", "unit_no"])
    quoted = F.concat(F.lit(rf"(?<![{T.WORD_CHAR}])\Q"), T.fold(F.col("skill")), F.lit(rf"\E(?![{T.WORD_CHAR}])"))
    return hits.where(F.call_function("rlike", F.col("folded"), quoted)).groupBy("cv_id", "skill").agg(F.min_by("unit_id", "unit_no").alias("literal"))


# --- Combination -------------------------------------------------------------------------------------------------
def combine_all(rows: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """All met → met; any met or partial → partial; else missing."""
    v = F.col(verdict)
    return rows.groupBy(*keys).agg(
        F.when(F.bool_and(v == "met"), "met").when(F.bool_or(v.isin("met", "partial")), "partial").otherwise("missing").alias("verdict")
    )


def combine_any(rows: DataFrame, keys: list[str], order: str, label: str, verdict: str = "verdict") -> DataFrame:
    """Best verdict, the first in ``order`` among equals; its label is missing unless it is met."""
    best = F.max_by(F.struct(F.col(verdict).alias("v"), F.col(label).alias("l")), F.struct(verdict_rank(F.col(verdict)), -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.v").alias("verdict"), F.when(F.col("b.v") != "met", F.col("b.l")).alias("missing_label")
    )


# --- Verdicts without skills -------------------------------------------------------------------------------------
def years_verdict(need: Column, years: Column, internship_months: Column) -> Column:
    have = years + internship_months / 24
    return (
        F.when(have >= need, "met")
        .when((have >= need * 0.5) | ((need <= 2) & (internship_months >= 3)), "partial")
        .otherwise("missing")
    )


def languages_verdict(languages: Column, text: Column, levels: Column) -> Column:
    """Worst verdict over the required languages; the level asked is at least 3."""
    asked = language_levels(text)
    ranks = F.transform(
        languages,
        lambda l: F.when(
            F.coalesce(F.element_at(levels, l), F.lit(0)) >= F.greatest(F.lit(3), F.coalesce(F.element_at(asked, l), F.lit(3))), 2
        )
        .when(F.coalesce(F.element_at(levels, l), F.lit(0)) > 0, 1)
        .otherwise(0),
    )
    return rank_verdict(F.coalesce(F.array_min(ranks), F.lit(0)))


def study_field_table(spark: SparkSession) -> DataFrame:
    """(concept, word): the built-in fields of study and their wordings, folded."""
    return spark.createDataFrame([(c, w) for c, words in STUDY_FIELDS.items() for w in words], "concept string, word string")


def with_concepts(texts: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """(keys, concept): the concepts that a text names. A wording counts inside words too ("electromechanical" names "mechanical"), so it can't be joined
    on words; the dictionary ``fields(concept, word)`` is one aggregated row, a few hundred wordings, that every text is held against."""
    one = F.broadcast(fields.groupBy("concept").agg(F.collect_set(F.lower("word")).alias("words")).agg(F.collect_list(F.struct("concept", "words")).alias("fields")))
    named = lambda f: F.exists(f["words"], lambda w: F.col("folded").contains(w))
    found = texts.select(*keys, T.fold(F.col("text")).alias("folded"), F.lit(1).alias("one")).join(one.withColumn("one", F.lit(1)), "one")
    return found.select(*keys, F.explode(F.filter("fields", named)).alias("f")).select(*keys, F.col("f.concept").alias("concept"))


def education_judgments(pairs: DataFrame, requirements: DataFrame, education: DataFrame, profiles: DataFrame, fields: DataFrame) -> DataFrame:
    """(cv_id, job_id, req_no, verdict, unit_id, note) of education requirements: the worst of their parts.

    ``requirements(job_id, req_no, text)``, ``education(cv_id, unit_no, unit_id, text)`` are the education lines, ``profiles(cv_id, seniority)``, ``fields(concept, word)`` the fields of
    study. Parts: the field (a common concept, any one will do; without a named field, engineering as such) and being a student. The cited line is the first
    with a common field, else the first. A candidate without education lines is missing.
    """
    wanted = with_concepts(requirements, ["job_id", "req_no"], fields)
    held = with_concepts(education, ["cv_id", "unit_no", "unit_id"], fields)
    by_req = wanted.groupBy("job_id", "req_no").agg(F.count(F.lit(1)).alias("n_wanted"))
    line = F.struct("unit_no", "unit_id")
    lines = education.groupBy("cv_id").agg(F.min(line).alias("first"), F.bool_or(T.fold(F.col("text")).rlike(ENGINEERING)).alias("engineer"))
    asked = pairs.select(*PAIR).distinct().join(
        requirements.select("job_id", "req_no", T.fold(F.col("text")).rlike(STUDENT_REQUIREMENT).alias("student"), T.fold(F.col("text")).rlike(ENGINEERING).alias("generic")), "job_id"
    )
    common = asked.select(*REQ).join(wanted, ["job_id", "req_no"]).join(held, ["cv_id", "concept"]).groupBy(*REQ).agg(F.min(line).alias("fitting"))
    x = (
        asked.join(by_req, ["job_id", "req_no"], "left").join(lines, "cv_id", "left").join(common, REQ, "left")
        .join(profiles.select("cv_id", (F.col("seniority") == "student").alias("is_student")), "cv_id", "left")
    )
    named, fits, is_student = F.col("n_wanted") > 0, F.col("fitting").isNotNull(), F.coalesce("is_student", F.lit(False))
    field = F.when(named, F.when(fits, 2).otherwise(1)).when(F.col("generic"), F.when(F.col("engineer"), 2).otherwise(1)).otherwise(2)
    as_student = F.when(F.col("student"), F.when(is_student, 2).otherwise(1)).otherwise(2)
    notes = F.concat_ws("; ", F.when(F.col("student"), F.when(is_student, "student").otherwise("asks for a student")), F.when(named & ~fits, "different field of study"))
    some = F.col("first").isNotNull()
    return x.select(
        *REQ, F.when(some, rank_verdict(F.least(field, as_student))).otherwise("missing").alias("verdict"),
        F.when(some, F.coalesce("fitting", "first")["unit_id"]).alias("unit_id"), F.when(some, notes).otherwise("no education section found").alias("note"),
    )


def has_topic(text: Column) -> Column:
    """A years requirement that also names a domain ("2+ years in DevOps")."""
    return F.regexp_replace(T.fold(text), FILLER, " ").rlike("[a-z]{3,}")


def candidate_facts(profiles: DataFrame, units: DataFrame) -> DataFrame:
    """Per candidate: levels, years, first experience units and the languages unit."""
    exp = F.when((F.col("section") == "experience") & (F.col("n") <= 2), F.struct("unit_no", "unit_id"))
    numbered = units.withColumn("n", F.row_number().over(W.partitionBy("cv_id", "section").orderBy("unit_no")))
    per_cv = numbered.groupBy("cv_id").agg(
        F.transform(F.array_sort(F.collect_list(exp)), lambda e: e["unit_id"]).alias("exp_ids"),
        F.min_by(F.when(F.col("section") == "languages", F.col("unit_id")), F.when(F.col("section") == "languages", F.col("unit_no"))).alias("lang_id"),
    )
    return profiles.select("cv_id", "years_experience", "internship_months", "seniority", F.col("languages").alias("levels")).join(
        per_cv, "cv_id", "left"
    )


def free_text_requirements(requirements: DataFrame) -> DataFrame:
    asked = F.coalesce("min_years", F.lit(0.0)) > 0
    return requirements.where(
        (F.size("skills") == 0) & (F.size("languages") == 0) & (F.col("category") != "education") & (~asked | has_topic(F.col("text")))
    )


def education_requirements(requirements: DataFrame) -> DataFrame:
    return requirements.where((F.col("category") == "education") & (F.size("skills") == 0))


def judge_free_text(best: DataFrame, backend: str = "tfidf") -> DataFrame:
    """``best(cv_id, job_id, req_no, unit_no, unit_id, score)`` to verdicts by the thresholds of the similarity."""
    met, partial = THRESHOLDS[backend]
    v = F.when(F.col("score") >= met, "met").when(F.col("score") >= partial, "partial").otherwise("missing")
    return best.withColumn("verdict", v).withColumn("note", F.format_string("closest CV line similarity %.2f", "score"))


def closest_units(
    pairs: DataFrame, free: DataFrame, units: DataFrame, unit_skills: DataFrame | None = None, req_skill_lists: DataFrame | None = None
) -> DataFrame:
    """(cv_id, job_id, req_no, unit_no, unit_id, score): the candidate line closest to each free-text requirement,
    by TF-IDF over the pair's own lines; each line carries its role and company line. Of equally close lines the first counts."""
    none = F.array().cast("array<string>")
    pool = units.where("section <> 'languages'")
    a = free.select("job_id", F.col("req_no").alias("chunk_no"), "text")
    sk = F.lit(None).cast("array<string>")
    a = a.withColumn("sk", sk)
    b = pool.withColumn("line", F.trim(F.concat_ws(" ", "context", "text")))
    b = b.join(unit_skills, ["cv_id", "unit_no"], "left") if unit_skills is not None else b.withColumn("skills", sk)
    if req_skill_lists is not None:
        a = a.drop("sk").join(req_skill_lists.select("job_id", F.col("req_no").alias("chunk_no"), F.col("skills").alias("sk")), ["job_id", "chunk_no"], "left")
    chunks = a.select("job_id", "chunk_no", line_terms(F.col("text"), F.coalesce("sk", none)).alias("terms"))
    lines = b.select("cv_id", "unit_no", line_terms(F.col("line"), F.coalesce("skills", none)).alias("terms"))
    wanted = pairs.select(*PAIR).distinct().join(a.select("job_id").distinct(), "job_id", "left_semi")
    scored = line_cosines(wanted, chunks, lines)
    best = scored.groupBy(*PAIR, F.col("chunk_no").alias("req_no")).agg(
        F.max_by(F.struct("unit_no", "cosine"), F.struct(F.round("cosine", COSINE_DIGITS), -F.col("unit_no"))).alias("b")
    )
    first = pool.groupBy("cv_id").agg(F.min("unit_no").alias("first_unit"))
    every = wanted.join(a.select("job_id", F.col("chunk_no").alias("req_no")), "job_id").join(first, "cv_id")
    out = every.join(best, REQ, "left").select(
        *REQ, F.coalesce("b.unit_no", "first_unit").alias("unit_no"), F.coalesce("b.cosine", F.lit(0.0)).alias("score")
    )
    return out.join(units.select("cv_id", "unit_no", "unit_id"), ["cv_id", "unit_no"])


BLOCK_VECTORS = 32
#: Cosines are compared by so many digits, or the order of addition would break ties.
COSINE_DIGITS = 9


def closest_by_vector(pairs: DataFrame, free: DataFrame, units: DataFrame, requirement_vectors: DataFrame, unit_vectors: DataFrame, block: int = BLOCK_VECTORS) -> DataFrame:
    """The columns of ``closest_units`` from given vectors: ``requirement_vectors(job_id, req_no, vec)``, ``unit_vectors(cv_id, unit_no, vec)``.

    The vectors of a candidate and of a posting lie in blocks of ``block``; inside a pair each block meets each block in one row, which gives the best line of the block
    for every requirement of the other. So a row never holds more than two blocks, what is shuffled on are these partial bests, and they are combined before the shuffle. Lines of the
    languages section take no part; a requirement or line without a vector counts as the zero vector.
    """
    pool = units.where("section <> 'languages'").select("cv_id", "unit_no", "unit_id")
    part = lambda c: F.floor((F.row_number().over(W.partitionBy(c[0]).orderBy(c[1])) - 1) / block)
    held = pool.join(unit_vectors.select("cv_id", "unit_no", unit_vector(F.col("vec")).alias("v")), ["cv_id", "unit_no"], "left")
    asked = free.select("job_id", "req_no").join(requirement_vectors.select("job_id", "req_no", unit_vector(F.col("vec")).alias("v")), ["job_id", "req_no"], "left")
    lists = lambda df, owner, no: df.withColumn("block", part((owner, no))).groupBy(owner, "block").agg(F.collect_list(F.struct(no, "v")).alias(f"of_{owner}")).drop("block")
    met = pairs.select(*PAIR).distinct().join(lists(asked, "job_id", "req_no"), "job_id").join(lists(held, "cv_id", "unit_no"), "cv_id")

    def best(r: Column) -> Column:
        score = lambda u: F.coalesce(dot(r["v"], u["v"]), F.lit(0.0))
        held = lambda u: T.bind(score(u), lambda s: F.struct(F.round(s, COSINE_DIGITS).alias("near"), (-u["unit_no"]).alias("less"), s.alias("score")))
        return F.struct(r["req_no"].alias("req_no"), F.array_max(F.transform("of_cv_id", held)).alias("b"))

    tops = met.select(*PAIR, explode_once(F.transform("of_job_id", best)).alias("r")).groupBy(*PAIR, F.col("r.req_no").alias("req_no")).agg(F.max("r.b").alias("b"))
    return tops.select(*REQ, (-F.col("b.less")).alias("unit_no"), F.col("b.score").alias("score")).join(pool, ["cv_id", "unit_no"])


# --- Judgments ---------------------------------------------------------------------------------------------------
def judge(
    pairs: DataFrame,
    requirements: DataFrame,
    skill_rows: DataFrame,
    facts: DataFrame,
    closest: DataFrame | None = None,
    backend: str = "tfidf",
    education: DataFrame | None = None,
) -> DataFrame:
    """(cv_id, job_id, req_no, verdict, evidence_ids, note, gap_type, cv_term, jd_term, missing_skills).

    ``closest`` are the lines closest to the free-text requirements by ``backend``, ``education`` the ``education_judgments``.
    """
    none = F.array().cast("array<string>")
    collected = skill_rows.groupBy(*REQ).agg(
        F.array_sort(F.collect_list(F.struct("at", "label", "verdict", "ids", "note", "cv_term", "jd_term"))).alias("sk")
    )
    x = pairs.select(*PAIR).distinct().join(requirements, "job_id").join(facts, "cv_id").join(collected, REQ, "left")
    if closest is not None:
        c = judge_free_text(closest, backend).select(*REQ, F.struct("verdict", "unit_id", "note").alias("free"))
        x = x.join(c, REQ, "left")
    else:
        x = x.withColumn("free", F.lit(None).cast("struct<verdict:string,unit_id:string,note:string>"))
    sk = F.coalesce("sk", F.array().cast("array<struct<at:int,label:string,verdict:string,ids:array<string>,note:string,cv_term:string,jd_term:string>>"))
    x = x.withColumn("sk", sk)
    any_of = (F.size("sk") > 1) & T.fold(F.col("text")).rlike(ANY_OF)
    top = F.array_max(F.transform("sk", lambda s: verdict_rank(s["verdict"])))
    best = F.slice(F.filter("sk", lambda s: verdict_rank(s["verdict"]) == top), 1, 1)
    x = x.withColumn("chosen", F.when(any_of, best).otherwise(F.col("sk")))
    asks_years = F.coalesce("min_years", F.lit(0.0)) > 0
    nothing = F.lit(None).cast("struct<verdict:string,unit_id:string,note:string>")
    if education is not None:
        x = x.join(education.select(*REQ, F.struct("verdict", "unit_id", "note").alias("edu_v")), REQ, "left")
    else:
        x = x.withColumn("edu_v", nothing)
    years = F.when(asks_years, years_verdict(F.col("min_years"), F.col("years_experience"), F.col("internship_months")))
    langs = F.when(F.size("languages") > 0, languages_verdict(F.col("languages"), F.col("text"), F.col("levels")))
    skill_verdicts = F.transform("chosen", lambda s: s["verdict"])
    lacks_all = asks_years & (F.size("chosen") > 0) & F.forall("chosen", lambda s: s["verdict"] == "missing")
    base = F.when(lacks_all, F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(years, langs, F.col("edu_v.verdict"))))
    verdicts = F.concat(base, skill_verdicts, F.array_compact(F.array(F.col("free.verdict"))))
    x = x.withColumn("verdicts", verdicts)
    combined = (
        F.when(F.size("verdicts") == 0, "missing")
        .when(F.forall("verdicts", lambda v: v == "met"), "met")
        .when(F.exists("verdicts", lambda v: v.isin("met", "partial")), "partial")
        .otherwise("missing")
    )
    x = x.withColumn("verdict", combined)
    evidence = F.concat(
        F.when(asks_years & (F.size("skills") == 0), F.coalesce("exp_ids", none)).otherwise(none),
        F.when(F.size("languages") > 0, F.array_compact(F.array("lang_id"))).otherwise(none),
        F.array_compact(F.array(F.col("edu_v.unit_id"))),
        F.flatten(F.transform("chosen", lambda s: s["ids"])),
        F.when(F.col("free.verdict") != "missing", F.array(F.col("free.unit_id"))).otherwise(none),
    )
    notes = F.filter(
        F.concat(
            F.array(F.when(asks_years, F.concat(F.lit("asks "), _short(F.col("min_years")), F.lit("+ yrs, CV shows ~"), _short(F.col("years_experience"))))),
            F.array(F.col("edu_v.note")),
            F.transform("chosen", lambda s: s["note"]),
            F.array(F.col("free.note")),
        ),
        lambda n: n.isNotNull() & (n != ""),
    )
    wording = F.try_element_at(F.filter("sk", lambda s: s["cv_term"].isNotNull()), F.lit(-1))
    gap = F.when((F.col("verdict") == "met") & wording["cv_term"].isNotNull(), "wording").when(F.col("verdict") == "met", "none").otherwise("skill")
    missing = F.array_distinct(F.transform(F.filter("chosen", lambda s: s["verdict"] != "met"), lambda s: s["label"]))
    return x.select(
        *REQ,
        "kind",
        "verdict",
        F.when(F.col("verdict") != "missing", F.slice(F.array_distinct(evidence), 1, 3)).otherwise(none).alias("evidence_ids"),
        F.substring(F.array_join(notes, "; "), 1, 160).alias("note"),
        gap.alias("gap_type"),
        F.when(gap == "wording", wording["cv_term"]).alias("cv_term"),
        F.when(gap == "wording", wording["jd_term"]).alias("jd_term"),
        F.when(F.col("verdict") != "met", missing).otherwise(none).alias("missing_skills"),
    )


def _short(c: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")


# --- External verdicts -------------------------------------------------------------------------------------------
def evidence_guard(verdicts: DataFrame, pairs_requirements: DataFrame, units: DataFrame, owned: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """Judgments from an external verdict table, keeping only cited lines that exist.

    ``verdicts(cv_id, job_id, req_no, verdict, evidence_ids, note, cv_term, jd_term)``;
    ``pairs_requirements(cv_id, job_id, req_no, kind, skills)``; ``owned(cv_id, skill)`` are the skills the candidate
    shows or implies. Met or partial without a valid citation becomes missing and counts as downgraded; a
    requirement without a verdict is missing with all its skills. The lines and the skills of a candidate join as one list each, so neither citations nor skills are rows of their own.
    """
    none = F.array().cast("array<string>")
    lines = units.groupBy("cv_id").agg(F.collect_set("unit_id").alias("held_lines"))
    shown = owned.groupBy("cv_id").agg(F.collect_set("skill").alias("held_skills"))
    cited = F.filter(F.transform("v.evidence_ids", lambda i: F.trim(i)), lambda i: F.array_contains("held_lines", i))
    lacking = F.filter("skills", lambda s: ~F.coalesce(F.array_contains("held_skills", s), F.lit(False)))
    x = (
        pairs_requirements.select(*REQ, "kind", "skills")
        .join(verdicts.select(*REQ, F.struct("verdict", "note", "cv_term", "jd_term", "evidence_ids").alias("v")), REQ, "left")
        .join(lines, "cv_id", "left")
        .join(shown, "cv_id", "left")
        .withColumn("ids", F.coalesce(cited, none))
        .withColumn("lacking", F.coalesce(lacking, none))
    )
    judged = F.col("v").isNotNull()
    down = judged & F.col("v.verdict").isin("met", "partial") & (F.size("ids") == 0)
    x = x.withColumn("downgraded", down).withColumn("verdict", F.when(~judged | down, "missing").otherwise(F.col("v.verdict")))
    v = F.col("verdict")
    wording = (v == "met") & (F.coalesce("v.cv_term", F.lit("")) != "") & (F.coalesce("v.jd_term", F.lit("")) != "") & (
        T.fold(F.col("v.cv_term")) != T.fold(F.col("v.jd_term"))
    )
    missing = (
        F.when(~judged, F.col("skills"))
        .when(v == "met", none)
        .when(F.size("lacking") > 0, F.col("lacking"))
        .when(v == "missing", F.col("skills"))
        .otherwise(none)
    )
    note = F.when(~judged, "not judged").when(down, "downgraded: no valid evidence cited").otherwise(F.substring(F.col("v.note"), 1, 160))
    return x.select(
        *REQ,
        "kind",
        "verdict",
        F.when(v != "missing", F.slice("ids", 1, 3)).otherwise(none).alias("evidence_ids"),
        note.alias("note"),
        F.when(wording, "wording").when(v == "met", "none").otherwise("skill").alias("gap_type"),
        F.when(wording, F.col("v.cv_term")).alias("cv_term"),
        F.when(wording, F.col("v.jd_term")).alias("jd_term"),
        missing.alias("missing_skills"),
        "downgraded",
    )


def downgrade_totals(guarded: DataFrame) -> DataFrame:
    return guarded.groupBy("cv_id").agg(F.count_if("downgraded").alias("downgraded"), F.count(F.lit(1)).alias("judged"))
