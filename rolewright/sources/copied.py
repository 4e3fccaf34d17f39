"""Postings people bring themselves: pasted batches, job pages copied whole, and captures sent from a browser.

A page is one row; its lines are an array, so nothing here shuffles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import as_postings

# Interface wording of a job page, English and French. Capitals match outside ASCII too, hence (?iu).
_A = "['’]"
DESCRIPTION_START = (
    rf"(?iu)^(about the job|job description|à propos de l{_A}offre d{_A}emploi|a propos de l{_A}offre d{_A}emploi|"
    rf"description du poste|description de l{_A}offre)$"
)
DESCRIPTION_END = (
    r"(?iu)^(show less|see less|afficher moins|voir moins|show more|see more|afficher plus|voir plus|… ?more|\.\.\. ?more|"
    rf"set alert for similar jobs|créer une alerte.*|about the company|à propos de l{_A}entreprise|a propos de l{_A}entreprise|"
    rf"seniority level|niveau hiérarchique|employment type|type d{_A}emploi|looking for talent\?|people also viewed|"
    rf"similar jobs|offres d{_A}emploi similaires|more jobs.*|referrals increase your chances.*|see who you know|"
    rf"meet the hiring team|rencontrez l{_A}équipe de recrutement|benefits found in job post|"
    r"get notified about new .*|sign in to create job alert|people you can reach out to)$"
)
_AGO_EN = r"(?:reposted\s+)?(?:[0-9]+|an?|one)\s+(?:minute|hour|day|week|month|year)s?\s+ago"
_AGO_FR = r"(?:republié\s+)?il y a\s+(?:[0-9]+|un|une)\s+[\p{L}\p{N}_]+"
META_LINE = rf"(?iu)^(.+?)\s+[·•]\s+(?:{_AGO_EN}|{_AGO_FR})"
AGO_LINE = rf"(?iu)^(?:{_AGO_EN}|{_AGO_FR})$"
APPLICANTS = (
    r"(?i)^(?:over |plus de )?[0-9][0-9\s,.]*\s+(?:applicants?|candidats?|people clicked apply|personnes ont cliqué sur postuler)\b.*$"
)
WORKPLACE_LABELS = {
    "remote": "remote", "à distance": "remote", "a distance": "remote", "télétravail": "remote",
    "hybrid": "hybrid", "hybride": "hybrid",
    "on-site": "onsite", "onsite": "onsite", "sur site": "onsite", "sur place": "onsite", "présentiel": "onsite",
}
INTERNSHIP_LABELS = ["internship", "stage", "stagiaire", "alternance", "apprenticeship"]
EMPLOYMENT_LABELS = INTERNSHIP_LABELS + [
    "full-time", "part-time", "contract", "temporary", "volunteer", "other", "freelance",
    "temps plein", "temps partiel", "cdi", "cdd", "contrat", "intérim", "bénévolat", "autre",
]
INTERFACE_LINES = [
    "skip to main content", "home", "my network", "jobs", "messaging", "notifications", "me", "for business",
    "share", "show more options", "easy apply", "apply", "save", "saved", "promoted", "promoted by hirer",
    "actively reviewing applicants", "responses managed off linkedin", "show match details", "tailor my resume",
    "help me stand out", "use ai to assess how you fit", "message", "follow", "report this job", "sign in",
    "join now", "join or sign in", "sign in to save", "apply on company website", "new", "be an early applicant",
    "show all", "exclusive job seeker insights", "job poster", "linkedin", "dismiss", "close", "back", "more",
    "your job search", "job alert", "set alert", "retry premium", "try premium", "premium",
    "passer au contenu principal", "accueil", "réseau", "emplois", "messagerie", "vous", "pour les entreprises",
    "partager", "afficher plus d'options", "candidature simplifiée", "postuler", "enregistrer", "enregistré", "promu",
    "promu par le recruteur", "examine activement les candidatures", "réponses gérées en dehors de linkedin",
    "envoyer un message", "suivre", "signaler cette offre", "s'identifier", "s'inscrire", "nouveau",
    "postuler sur le site de l'entreprise", "voir les détails de la correspondance", "auteur de l'offre d'emploi",
]
PAGE_MARKERS = [
    "skip to main content", "my network", "easy apply", "show more options", "promoted by hirer", "report this job",
    "join now", "seniority level", "employment type", "job function", "set alert for similar jobs", "about the company",
    "passer au contenu principal", "candidature simplifiée", "signaler cette offre", "niveau hiérarchique",
    "type d'emploi", "afficher plus d'options", "à propos de l'entreprise",
]


def is_interface(line: Column) -> Column:
    """True for a line that belongs to the page's own menus and buttons."""
    low = F.regexp_replace(F.replace(F.lower(line), F.lit("’"), F.lit("'")), r"\.+$", "")
    return (
        low.isin(*INTERFACE_LINES, *WORKPLACE_LABELS, *EMPLOYMENT_LABELS)
        | low.endswith(" logo")
        | low.rlike(r"^(?:logo de |logo of |try premium|retry premium|essayer premium|save |enregistrer )")
        | low.rlike(APPLICANTS)
        | low.rlike(r"^[0-9]+\s*(?:notifications?|new|nouveaux?)$")
    )


def _first_index(lines: Column, test) -> Column:
    """0-based index of the first line that passes, null when none does."""
    hits = F.filter(F.transform(lines, lambda s, i: F.when(test(s), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def _head(lines: Column, n: Column) -> Column:
    return F.slice(lines, F.lit(1), F.greatest(n, F.lit(0)))


def workplace_of_lines(lines: Column) -> Column:
    """A line that is a workplace label decides; else the words in the text."""
    low = F.transform(lines, F.lower)
    label = F.get(F.filter(low, lambda s: s.isin(*WORKPLACE_LABELS)), F.lit(0))
    joined = F.array_join(low, " ")
    kinds = F.create_map(*[F.lit(x) for pair in WORKPLACE_LABELS.items() for x in pair])
    return (
        F.when(label.isNotNull(), F.element_at(kinds, label))
        .when(joined.rlike(r"(?U)\b(remote|télétravail|teletravail|à distance)\b"), "remote")
        .when(joined.rlike(r"\b(hybrid|hybride)\b"), "hybrid")
        .otherwise("unknown")
    )


def extract_copied_pages(pages: DataFrame, key: str = "page_id", col: str = "text") -> DataFrame:
    """(key, title, company, location, workplace, internship, description) of pages copied whole.

    Menus are dropped. The title, company and location are the last remaining lines before the line that
    carries the age of the posting. The description runs from its heading (or, without one, from the first
    line after the buttons) to the first closing marker.
    """
    lines = F.filter(F.transform(T.split_lines(T.clean_text(F.col(col))), T.one_line), lambda s: s != "")
    p = pages.select(key, lines.alias("lines")).withColumn("start", _first_index(F.col("lines"), lambda s: s.rlike(DESCRIPTION_START)))
    p = p.withColumn("head", _head(F.col("lines"), F.coalesce("start", F.lit(60))))
    p = p.withColumn("meta_at", _first_index(F.col("head"), lambda s: s.rlike(META_LINE) | s.rlike(AGO_LINE)))
    meta = F.get("head", "meta_at")
    p = p.withColumn("meta", meta).withColumn("with_place", F.coalesce(meta.rlike(META_LINE), F.lit(False)))
    before = F.filter(_head(F.col("head"), F.coalesce("meta_at", F.lit(0))), lambda s: ~is_interface(s))
    p = p.withColumn("before", before).withColumn("n", F.size("before"))

    def back(i: int) -> Column:
        return F.coalesce(F.get("before", F.col("n") - i), F.lit(""))

    def pick(when_meta: Column, when_three: Column, when_two: Column) -> Column:
        return F.when(F.col("with_place"), when_meta).when(F.col("n") >= 3, when_three).when(F.col("n") == 2, when_two).otherwise("")

    p = p.select(
        "*",
        pick(back(1), back(3), back(2)).alias("title0"),
        pick(F.when(F.col("n") > 1, back(2)).otherwise(""), back(2), back(1)).alias("company"),
        pick(F.trim(F.regexp_extract("meta", META_LINE, 1)), back(1), F.lit("")).alias("location"),
    )
    # First line after the age line that is neither a button nor another age line.
    after_buttons = F.aggregate(
        F.slice("lines", F.col("meta_at") + 2, 1_000_000_000),
        F.struct((F.col("meta_at") + 1).alias("at"), F.lit(True).alias("skipping")),
        lambda acc, s: F.when(
            acc["skipping"] & (is_interface(s) | s.rlike(AGO_LINE)), F.struct((acc["at"] + 1).alias("at"), F.lit(True).alias("skipping"))
        ).otherwise(F.struct(acc["at"].alias("at"), F.lit(False).alias("skipping"))),
        lambda acc: acc["at"],
    )
    p = p.withColumn("from", F.coalesce(F.col("start") + 1, F.when(F.col("meta_at").isNotNull(), after_buttons)))
    tail = F.slice("lines", F.col("from") + 2, 1_000_000_000)
    stop = F.coalesce(_first_index(tail, lambda s: s.rlike(DESCRIPTION_END)), F.size(tail))
    body = F.slice("lines", F.col("from") + 1, F.least(stop + 1, F.size("lines")))
    top = _head(F.col("head"), F.coalesce("meta_at", F.lit(0)) + 12)
    fallback = F.get(F.filter("head", lambda s: ~is_interface(s) & (F.length(s) <= 120)), F.lit(0))
    return p.select(
        key,
        F.coalesce(F.nullif("title0", F.lit("")), fallback, F.lit("")).alias("title"),
        "company",
        "location",
        workplace_of_lines(top).alias("workplace"),
        F.exists(top, lambda s: F.lower(s).isin(*INTERNSHIP_LABELS)).alias("internship"),
        F.coalesce(F.when(F.col("from").isNotNull(), F.trim(F.array_join(body, "\n"))), F.lit("")).alias("description"),
    )


def looks_copied(text: Column) -> Column:
    """True for a job page copied whole rather than a clean posting."""
    lines = F.transform(F.slice(T.split_lines(text), 1, 400), lambda s: F.replace(T.one_line(s), F.lit("’"), F.lit("'")))
    started = F.exists(lines, lambda s: s.rlike(DESCRIPTION_START)) & F.exists(lines, lambda s: is_interface(s) | s.rlike(META_LINE))
    marks = F.size(F.array_intersect(F.transform(lines, F.lower), F.array(*[F.lit(m) for m in PAGE_MARKERS])))
    marks = (
        marks
        + F.exists(lines, lambda s: s.rlike(APPLICANTS)).cast("int")
        + F.exists(lines, lambda s: s.rlike(META_LINE)).cast("int")
    )
    return started | (marks >= 2) | F.lower(text).contains("linkedin.com/jobs")


# --- Pasted batches ------------------------------------------------------------------------------------------
PASTED_KEYS = {"title": "title|poste", "company": "company|entreprise", "location": "location|lieu", "url": "url"}
#: Of a pasted batch: postings that a user may want to be the most, lines that may hold ``Title:`` and the like.
PASTED_LIMIT, PASTED_META_LINES = 10, 6


def split_pasted(batches: DataFrame, key: str = "batch_id", col: str = "text", limit: int | None = None) -> DataFrame:
    """Postings of pasted batches: blocks between ``---`` lines, the first ``limit`` of a batch if that is given, with optional
    ``Title:`` / ``Company:`` / ``Location:`` / ``URL:`` lines (or their French names) among the first six. The id is the whole digest of a block: ten digits of it
    collide within a million postings."""
    blocks = F.filter(F.transform(F.split(T.clean_text(F.col(col)), r"\n\s*-{3,}\s*\n"), T.strip), lambda b: b != "")
    b = batches.select(key, F.posexplode(F.slice(blocks, 1, limit) if limit else blocks).alias("i", "block")).withColumn(
        "lines", T.split_lines(F.col("block"))
    )
    any_key = "|".join(PASTED_KEYS.values())
    top = F.slice("lines", 1, PASTED_META_LINES)
    meta_re = rf"(?i)^\s*({any_key})\s*:\s*(.+?)\s*$"

    def meta(name: str) -> Column:
        pat = rf"(?i)^\s*({PASTED_KEYS[name]})\s*:\s*(.+?)\s*$"
        found = F.filter(top, lambda s: s.rlike(pat))
        return F.regexp_extract(F.element_at(F.when(F.size(found) > 0, found), -1), pat, 2)

    body_start = F.coalesce(F.array_max(F.transform(top, lambda s, i: F.when(s.rlike(meta_re), i + 1))), F.lit(0))
    b = b.select(
        "*", *[meta(m).alias(f"m_{m}") for m in PASTED_KEYS], body_start.alias("body_start"), looks_copied(F.col("block")).alias("copied")
    )
    rest = T.strip(F.array_join(F.slice("lines", F.col("body_start") + 1, 1_000_000_000), "\n"))
    b = b.withColumn("body", F.when(rest != "", rest).otherwise(F.col("block"))).withColumn(
        "digest", F.sha1("block")
    )
    low = F.lower(F.concat_ws(" ", F.coalesce("m_location", F.lit("")), "body"))
    b = b.withColumn(
        "place", F.when(low.rlike("remote|télétravail"), "remote").when(low.contains("hybrid"), "hybrid").otherwise("unknown")
    )
    parsed = extract_copied_pages(b.where("copied").select("digest", "block").dropDuplicates(["digest"]), "digest", "block")
    parsed = parsed.where(F.length("description") >= 80).select("digest", F.struct(*[c for c in parsed.columns if c != "digest"]).alias("li"))
    b = b.join(parsed, "digest", "left")
    li_place = F.nullif(F.col("li.workplace"), F.lit("unknown"))
    title = F.coalesce(F.col("m_title"), F.nullif(F.substring("li.title", 1, 120), F.lit("")), F.substring(F.trim(F.get("lines", F.lit(0))), 1, 90))
    return as_postings(
        b.select(
            F.concat(F.lit("pasted:"), "digest").alias("job_id"),
            F.lit("pasted").alias("source"),
            F.lit("Pasted posting").alias("source_label"),
            F.coalesce(
                "m_company", F.nullif("li.company", F.lit("")), F.concat(F.lit("Pasted posting "), (F.col("i") + 1).cast("string"))
            ).alias("company"),
            title.alias("title"),
            F.coalesce("m_location", "li.location", F.lit("")).alias("location"),
            F.coalesce(li_place, "place").alias("workplace"),
            F.coalesce("m_url", F.lit("")).alias("url"),
            F.coalesce("li.description", "body").alias("description"),
            F.lit("Pasted by you").alias("attribution"),
        )
    )


# --- Captures ------------------------------------------------------------------------------------------------
def captures_to_postings(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, rejects). A selection of 200 characters wins; else the description when it has 120; else the
    copied page. Under 80 characters the capture is rejected. The id is the number in the URL, else a digest."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    def line(c: str, n: int) -> Column:
        return F.substring(T.one_line(blank(c)), 1, n)

    c = captures.select(
        *[blank(x).alias(x) for x in ("url", "title", "company", "location", "top", "description", "page_text", "selection")]
    ).withColumn("capture_id", F.sha2(F.concat_ws("\u0001", *captures.columns), 256))
    body_lines = T.split_lines(T.clean_text(F.col("description")))
    opened = F.aggregate(
        body_lines,
        F.struct(F.lit(True).alias("opening"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(acc["opening"] & ((F.trim(s) == "") | T.one_line(s).rlike(DESCRIPTION_START)), acc).otherwise(
            F.struct(F.lit(False).alias("opening"), F.concat(acc["out"], F.array(s)).alias("out"))
        ),
        lambda acc: T.strip(F.array_join(acc["out"], "\n")),
    )
    c = c.withColumn("sel", T.clean_text(F.col("selection"))).withColumn("desc0", opened)
    needs_page = (F.col("page_text") != "") & ((F.length("desc0") < 120) | (F.trim("title") == ""))
    parsed = extract_copied_pages(c.where(needs_page).dropDuplicates(["capture_id"]), "capture_id", "page_text")
    parsed = parsed.select("capture_id", F.struct(*[x for x in parsed.columns if x != "capture_id"]).alias("page"))
    c = c.dropDuplicates(["capture_id"]).join(parsed, "capture_id", "left")
    c = c.withColumn(
        "body",
        F.when(F.length("sel") >= 200, F.col("sel"))
        .when((F.length("desc0") < 120) & (F.length("page.description") >= 120), F.col("page.description"))
        .otherwise(F.col("desc0")),
    )
    rejects = c.where(F.length("body") < 80).select("url", "title", F.lit("no description found").alias("reason"))
    ok = c.where(F.length("body") >= 80)
    title = F.coalesce(F.nullif(line("title", 160), F.lit("")), F.nullif("page.title", F.lit("")), F.lit("LinkedIn job"))
    company = F.coalesce(F.nullif(line("company", 120), F.lit("")), F.nullif("page.company", F.lit("")), F.lit(""))
    ok = ok.select("*", title.alias("t"), company.alias("co")).withColumn(
        "loc", F.coalesce(F.nullif(line("location", 120), F.lit("")), F.nullif("page.location", F.lit("")), F.lit(""))
    )
    low = F.lower(T.one_line(T.clean_text(F.col("top"))))
    from_top = (
        F.when(low.rlike(r"\b(hybrid|hybride)\b"), "hybrid")
        .when(low.rlike(r"(?U)\b(remote|télétravail|teletravail)\b|à distance"), "remote")
        .when(low.rlike(r"\b(on-site|onsite)\b|sur site|sur place"), "onsite")
    )
    around = F.transform(T.split_lines(F.concat_ws("\n", "loc", "body")), T.one_line)
    place = F.coalesce(from_top, F.nullif("page.workplace", F.lit("unknown")), workplace_of_lines(around))
    intern = low.rlike(r"\b(internship|stage|stagiaire|alternance|apprenticeship)\b") | F.coalesce("page.internship", F.lit(False))
    number = F.regexp_extract("url", r"/jobs/view/(?:[^/?#]*?-)?([0-9]{6,})|[?&]currentJobId=([0-9]{6,})", 1)
    number = F.coalesce(
        F.nullif(number, F.lit("")), F.nullif(F.regexp_extract("url", r"[?&]currentJobId=([0-9]{6,})", 1), F.lit(""))
    )
    ident = F.coalesce(number, F.substring(F.sha1(F.lower(F.concat_ws("|", "t", "co"))), 1, 12))
    kept_url = F.when(F.col("url").startswith("https://") & F.col("url").contains("/jobs/"), F.col("url")).otherwise("")
    postings = as_postings(
        ok.select(
            F.concat(F.lit("linkedin:"), ident).alias("job_id"),
            F.lit("linkedin").alias("source"),
            F.lit("LinkedIn").alias("source_label"),
            F.coalesce(F.nullif("co", F.lit("")), F.lit("Company not shown")).alias("company"),
            F.col("t").alias("title"),
            F.col("loc").alias("location"),
            place.alias("workplace"),
            F.coalesce(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number, F.lit("/")), kept_url).alias("url"),
            F.col("body").alias("description"),
            F.when(intern, F.array(F.lit("Internship"))).otherwise(F.array().cast("array<string>")).alias("tags"),
            F.lit("Saved by you from LinkedIn").alias("attribution"),
        )
    )
    return postings, rejects
