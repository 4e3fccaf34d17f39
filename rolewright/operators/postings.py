"""Posting layout and requirements. A posting keeps its lines in one row until its requirements are known."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..cluster import cut_lineage
from ..functions import text as T
from .languages import language_hits
from .lines import language_of
from .mentions import tag_mentions

# Posting headings (folded), cue words, level words.
HEADINGS = {
    "must": [
        "requirements", "required", "required skills", "required qualifications", "minimum qualifications",
        "basic qualifications", "qualifications", "what you bring", "what we're looking for", "what we are looking for",
        "who you are", "your profile", "about you", "you have", "you should have", "must have", "must-have",
        "must haves", "skills and experience", "skills & experience", "experience", "key requirements",
        "profil recherche", "votre profil", "profil", "competences requises", "prerequis", "exigences",
        "ce que nous recherchons", "qualifications requises", "vous avez", "anforderungen", "ihr profil",
        "dein profil", "was du mitbringst", "das bringst du mit", "was sie mitbringen", "technical skills",
    ],
    "nice": [
        "nice to have", "nice-to-have", "nice to haves", "bonus", "bonus points", "preferred qualifications",
        "preferred", "pluses", "a plus", "it's a plus", "would be great", "extra credit", "good to have",
        "un plus", "atouts", "serait un plus", "souhaite", "souhaitable", "idealement", "competences appreciees",
        "wunschenswert", "von vorteil", "plus",
    ],
    "duties": [
        "responsibilities", "what you'll do", "what you will do", "the role", "your role", "role", "your mission",
        "missions", "vos missions", "mission", "taches", "vos responsabilites", "responsabilites", "in this role",
        "day to day", "deine aufgaben", "ihre aufgaben", "aufgaben", "what you will work on", "key responsibilities",
    ],
    "skip": [
        "benefits", "what we offer", "we offer", "perks", "perks and benefits", "why join us", "why us",
        "compensation", "salary", "avantages", "nous offrons", "ce que nous offrons", "pourquoi nous rejoindre",
        "about us", "about the company", "who we are", "our company", "qui sommes-nous", "qui sommes nous",
        "a propos", "wir bieten", "uber uns", "equal opportunity", "diversity", "how to apply", "application process",
        "recruitment process", "processus de recrutement", "location", "the company", "l'entreprise", "entreprise",
    ],
}
NICE_CUE = (
    r"\b(nice to have|a plus|is a plus|bonus|preferred|preferably|ideally|advantage|is an asset|desirable|"
    r"un plus|un atout|serait apprecie|apprecie|souhaite|souhaitable|idealement|von vorteil|wunschenswert)\b"
)
SKIP_LINE = r"\b(equal opportunity|we are an equal|accommodation|visa sponsorship|salary range|benefits include)\b"
REQUIREMENT_WORD = (
    r"\b(experience|knowledge|proficien|familiar|degree|skills?|years?|fluent|ability|"
    r"maitrise|connaissance|diplome|ans d'experience|bac\s*\+)"
)
YEARS = r"([0-9]{1,2})\s*\+?\s*(?:(?:-|to|a|bis)\s*[0-9]{1,2}\s*)?(?:years?|yrs|ans|annees|jahre)"
DEGREE = (
    r"\b(degree|bachelor'?s?|master'?s?|msc|bsc|phd|engineering school|diplomee?s?|ingenieurs?|licence|bac\s*\+\s*[0-9]|"
    r"grande ecole|studium|abschluss|graduate in|graduated|student|etudiante?s?|final[- ]year|derniere annee|"
    r"fin d'etudes|laufendes|vocational|bts)\b"
)
STUDENT_REQUIREMENT = (
    r"\b(student|etudiante?s?|final[- ]year|derniere annee|fin d'etudes|laufendes studium|enrolled|currently studying)\b"
)
SOFT = (
    r"\b(team player|communication skills|communicat|autonom|proactive|curious|curiosity|motivated|passion|"
    r"rigueur|rigoureu|esprit d'equipe|sens de|organized|organised|detail[- ]oriented|self[- ]starter|"
    r"ownership|growth mindset|interpersonal|teamwork|travail en equipe|dynamique|adaptab|explain|"
    r"stakeholder|present findings)"
)
LANGUAGE_REQUIREMENT = (
    r"\b(fluent|fluency|speak|spoken|written|proficien|native|langue|language|maitrise|courant|bilingu|niveau|level|c1|c2|b2)\b"
)
TITLE_LEVELS = [
    ("intern", r"\b(intern|internship|stagiaire|stage|pfe|apprentice|apprenticeship|alternance|alternant|werkstudent|praktikum|trainee)\b"),
    ("lead", r"\b(lead|principal|staff|head of|manager|chef|director|directeur|responsable)\b"),
    ("senior", r"\b(senior|sr|confirme|experimente|expert)\b"),
    ("junior", r"\b(junior|jr|graduate|entry[- ]level|debutant|jeune diplome|new grad)\b"),
]
#: Limits a user may ask for: musts and requirements of a posting, characters of a requirement, characters that tell two wordings apart.
MUST_LIMIT, REQUIREMENT_LIMIT, REQUIREMENT_CHARS, WORDING_CHARS = 10, 14, 220, 90


def heading_kind(line: Column, headings: dict[str, list[str]] = HEADINGS) -> Column:
    """Section a heading line opens, else null: the exact heading, else a heading of more than five characters
    that starts a line of at most seven words."""
    def kind_of(f: Column) -> Column:
        exact, starts = F, F
        for kind, names in headings.items():
            exact = exact.when(f.isin(*names), kind)
            longer = [n for n in names if len(n) > 5]
            if longer:
                starts = starts.when(f.rlike("^(?:" + "|".join(longer) + ")"), kind)
        return F.coalesce(exact, F.when(T.word_count(f) <= 7, starts))

    def short(s: Column) -> Column:
        bare = T.strip(F.regexp_replace(s, r":+$", ""))
        folded = T.strip_chars(F.regexp_replace(T.fold(bare), r"\s+", " "), " :!?")
        fits = (s != "") & (F.length(s) <= 70) & ~s.endswith(".") & ~s.rlike(r":\s*\S")
        return F.when(fits, T.bind(folded, kind_of))

    return T.bind(T.strip(T.strip_chars(T.strip(line), r"#*_=—•-")), short)


def layout(description: Column, headings: dict[str, list[str]] = HEADINGS) -> Column:
    """Array of struct(section, text, is_bullet) of a description, headings left out. A line belongs to the
    last heading above it; before any heading it is ``intro``."""
    lines = F.filter(T.split_lines(description), lambda s: F.trim(s) != "")
    parsed = F.transform(
        lines, lambda s, i: F.struct(i.alias("i"), heading_kind(s, headings).alias("kind"), T.bullet_parts(s).alias("b"))
    )

    def place(p: Column, opened: Column) -> Column:
        above = F.filter(opened, lambda h: h["i"] < p["i"])
        section = F.coalesce(F.try_element_at(above, F.lit(-1))["kind"], F.lit("intro"))
        return F.struct(section.alias("section"), p["b"]["text"].alias("text"), p["b"]["is_bullet"].alias("is_bullet"))

    def placed(x: Column) -> Column:
        body = F.filter(x, lambda p: p["kind"].isNull() & (p["b"]["text"] != ""))
        return T.bind(F.filter(x, lambda p: p["kind"].isNotNull()), lambda opened: F.transform(body, lambda p: place(p, opened)))

    return T.bind(parsed, placed)


def split_postings(postings: DataFrame, headings: dict[str, list[str]] = HEADINGS) -> DataFrame:
    """(job_id, line_no, section, text, is_bullet)."""
    return postings.select("job_id", F.posexplode_outer(layout(F.col("description"), headings)).alias("pos", "l")).select(
        "job_id", (F.col("pos") + 1).alias("line_no"), "l.section", "l.text", "l.is_bullet"
    ).where("text is not null")


def requirement_lines(postings: DataFrame, headings: dict[str, list[str]] = HEADINGS) -> DataFrame:
    """(job_id, line_no, kind, text) candidate requirement lines. Whether the posting has a requirement section
    is known inside its row, so no shuffle is needed."""
    p = postings.select("job_id", layout(F.col("description"), headings).alias("lines"))
    p = p.withColumn("sectioned", F.exists("lines", lambda x: x["section"].isin("must", "nice")))
    x = (
        p.select("job_id", "sectioned", F.posexplode_outer("lines").alias("pos", "l"))
        .select("job_id", "sectioned", (F.col("pos") + 1).alias("line_no"), "l.section", "l.text", T.fold(F.col("l.text")).alias("f"))
        .where(~F.col("f").rlike(SKIP_LINE))
    )
    outside = F.regexp_replace("f", r"\([^)]*\)", " ")
    in_section = F.col("section").isin("must", "nice")
    loose = ~F.col("sectioned") & F.col("section").isin("intro", "duties") & F.col("f").rlike(REQUIREMENT_WORD)
    kind = F.when(
        in_section, F.when((F.col("section") == "must") & outside.rlike(NICE_CUE), "nice").otherwise(F.col("section"))
    ).when(loose, F.when(F.col("f").rlike(NICE_CUE), "nice").otherwise("must"))
    return x.where("text is not null").select("job_id", "line_no", kind.alias("kind"), "text").where("kind is not null")


def content_chunks(postings: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """(job_id, chunk_no, text) of the lines used for retrieval: requirements, then duties, then longer intro
    lines; the description when there is none. ``limit`` lines of ``chars`` characters each, if these are given; else all of them, whole."""
    def head(text: Column | str) -> Column:
        return F.substring(text, 1, chars) if chars else F.col(text) if isinstance(text, str) else text

    def section(lines: Column, *names: str, words: int = 0) -> Column:
        return F.filter(
            lines,
            lambda p: p["section"].isin(*names)
            & (F.length(p["text"]) >= 12)
            & ((T.word_count(p["text"]) >= words) if words else F.lit(True))
            & ~T.fold(p["text"]).rlike(SKIP_LINE),
        )

    def chosen(lines: Column) -> Column:
        ordered = F.concat(section(lines, "must", "nice"), section(lines, "duties"), section(lines, "intro", words=5))
        return F.transform(F.slice(ordered, 1, limit) if limit else ordered, lambda p: head(p["text"]))

    chunks = T.bind(layout(F.col("description")), chosen)
    whole = T.bind(chunks, lambda c: F.when(F.size(c) == 0, F.array(head("description"))).otherwise(c))
    return postings.select("job_id", F.posexplode_outer(whole).alias("pos", "text")).select(
        "job_id", (F.col("pos") + 1).alias("chunk_no"), "text"
    )


def extract_requirements(
    postings: DataFrame, aliases: DataFrame, candidates: DataFrame | None = None, must_limit: int | None = None, limit: int | None = None, chars: int | None = None
) -> DataFrame:
    """(job_id, req_no, text, kind, category, skills, min_years, languages) from the postings' own lines.

    ``candidates`` (job_id, line_no, kind, text) may come from elsewhere; by default they are the lines of
    ``requirement_lines``. Everything is keyed by (job_id, line_no); a posting has few candidate lines. All requirements are kept whole unless ``must_limit``,
    ``limit`` (see ``prioritise``) or ``chars`` say otherwise.
    """
    # Tagging and assembling both read the candidate lines; they are few compared with the postings' text.
    lines = cut_lineage(candidates if candidates is not None else requirement_lines(postings))
    skills = (
        tag_mentions(lines, ["job_id", "line_no"], "text", aliases)
        .groupBy("job_id", "line_no", "skill")
        .agg(F.min(F.struct("pos", (-F.length("surface")).alias("neg"))).alias("at"))
        .groupBy("job_id", "line_no")
        .agg(F.array_sort(F.collect_list(F.struct("at.pos", "at.neg", "skill"))).alias("found"))
        .select("job_id", "line_no", F.transform("found", lambda s: s["skill"]).alias("skills"))
    )
    none = F.array().cast("array<string>")
    x = (
        lines.join(skills, ["job_id", "line_no"], "left")
        .withColumn("skills", F.coalesce("skills", none))
        .withColumn("f", T.fold(F.col("text")))
        .withColumn("named", F.array_distinct(F.transform(language_hits(F.col("text")), lambda h: h["lang"])))
    )
    n_skills = F.size("skills")
    asks_language = F.col("f").rlike(LANGUAGE_REQUIREMENT) | (T.word_count(F.col("text")) <= 6)
    years = F.regexp_extract("f", YEARS, 1)
    x = x.withColumn("languages", F.when(asks_language, F.col("named")).otherwise(none)).withColumn(
        "min_years", F.when(years != "", years.cast("double"))
    )
    too_short = (F.length("text") < 3) | ((F.length("text") < 8) & (n_skills == 0) & (F.size("named") == 0))
    x = x.where(~too_short)
    x = dedupe_lines(x)
    soft = (n_skills == 0) & (F.size("languages") == 0) & F.col("min_years").isNull() & ~F.col("f").rlike(DEGREE) & F.col("f").rlike(SOFT)
    x = x.where(~soft)
    category = (
        F.when(F.col("min_years").isNotNull(), "experience")
        .when((F.size("languages") > 0) & (n_skills == 0), "language")
        .when((F.col("f").rlike(DEGREE) | F.col("f").rlike(STUDENT_REQUIREMENT)) & (n_skills == 0), "education")
        .when(F.col("f").contains("certif") & (n_skills == 0), "certification")
        .when(n_skills > 0, "skill")
        .otherwise("domain")
    )
    return prioritise(
        x.select(
            "job_id", "line_no", (T.truncate(F.col("text"), chars) if chars else T.strip(F.col("text"))).alias("text"), "kind", category.alias("category"),
            "skills", "min_years", "languages",
        ),
        must_limit, limit,
    )


def dedupe_lines(lines: DataFrame, key_chars: int | None = None) -> DataFrame:
    """First line per posting and folded wording, or the first ``key_chars`` characters of that."""
    wording = T.strip(F.regexp_replace(T.fold(F.col("text")), rf"[^{T.WORD_CHAR}]+", " "))
    key = F.substring(wording, 1, key_chars) if key_chars else F.xxhash64(wording)
    first = W.partitionBy("job_id", "__key").orderBy("line_no")
    # One shuffle by posting serves this window and the ones of ``prioritise``.
    return lines.repartition("job_id").withColumn("__key", key).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__key", "__rn")


def prioritise(lines: DataFrame, must_limit: int | None = None, limit: int | None = None) -> DataFrame:
    """First ``must_limit`` musts, then nices up to ``limit`` in all, as far as these are given; in text order as ``req_no`` 1, 2, …"""
    of_kind = W.partitionBy("job_id", "kind").orderBy("line_no")
    by_kind = W.partitionBy("job_id").orderBy((F.col("kind") == "nice").cast("int"), "line_no")
    in_text = W.partitionBy("job_id").orderBy("line_no")
    if must_limit:
        lines = lines.withColumn("__k", F.row_number().over(of_kind)).where((F.col("kind") != "must") | (F.col("__k") <= must_limit)).drop("__k")
    if limit:
        lines = lines.withColumn("__k", F.row_number().over(by_kind)).where(F.col("__k") <= limit).drop("__k")
    return lines.withColumn("req_no", F.row_number().over(in_text).cast("int")).drop("line_no")


def title_level(title: Column, min_years: Column) -> Column:
    f = T.fold(title)
    out = F
    for level, pattern in TITLE_LEVELS:
        out = out.when(f.rlike(pattern), level)
    return out.when(min_years >= 6, "senior").when(min_years >= 3, "mid").when(min_years.isNotNull(), "junior").otherwise("unspecified")


def posting_facts(postings: DataFrame, requirements: DataFrame) -> DataFrame:
    """(job_id, n_must, n_nice, min_years, languages, seniority, workplace, posting_language)."""
    per_job = requirements.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "must").alias("n_must"),
        F.count_if(F.col("kind") == "nice").alias("n_nice"),
        F.max(F.when(F.col("kind") == "must", F.col("min_years"))).alias("min_years"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"),
    )
    tagged = F.when(
        (F.col("source") == "linkedin") & F.array_contains("tags", "Internship"), F.concat("title", F.lit(" internship"))
    ).otherwise(F.col("title"))
    return postings.join(per_job, "job_id", "left").select(
        "job_id",
        F.coalesce("n_must", F.lit(0)).alias("n_must"),
        F.coalesce("n_nice", F.lit(0)).alias("n_nice"),
        "min_years",
        F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        title_level(tagged, F.col("min_years")).alias("seniority"),
        "workplace",
        language_of(F.col("description")).alias("posting_language"),
    )
