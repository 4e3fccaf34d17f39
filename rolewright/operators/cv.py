"""Candidate documents: sections, evidence units, experience, profile.

Segmentation explodes a document into its lines once and reads the state of a line (section, pending role lines, wrapped line) off windows over the
lines before it; everything after that works on the arrays of lines and units in the document's row.
"""
from __future__ import annotations

import unicodedata
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..cluster import explode_once
from ..functions import roles as R
from ..functions import text as T
from .languages import language_hits, language_levels
from .lines import language_of, name_candidates, pack_sentences, redact
from .mentions import tag_mentions

# Section headings (folded), months, date wording, role words, places.
SECTIONS = {
    "summary": [
        "summary", "professional summary", "profile", "professional profile", "about me", "about", "objective",
        "career objective", "personal statement", "profil", "profil professionnel", "resume", "a propos",
        "a propos de moi", "objectif", "objectif professionnel", "presentation",
    ],
    "experience": [
        "experience", "experiences", "work experience", "professional experience", "employment", "employment history",
        "work history", "internships", "internship", "relevant experience", "experience professionnelle",
        "experiences professionnelles", "parcours professionnel", "stages", "stage", "berufserfahrung",
    ],
    "projects": [
        "projects", "project", "academic projects", "personal projects", "selected projects", "key projects",
        "projets", "projet", "projets academiques", "projets personnels", "realisations", "projets realises",
    ],
    "education": [
        "education", "academic background", "academic record", "formation", "formations", "etudes", "diplomes",
        "cursus", "parcours academique", "ausbildung", "education and training",
    ],
    "skills": [
        "skills", "technical skills", "core skills", "key skills", "competencies", "core competencies", "tools",
        "technologies", "tech stack", "skills and tools", "competences", "competences techniques", "outils",
        "outils et technologies", "savoir-faire", "kenntnisse", "it skills", "software", "logiciels",
    ],
    "certifications": [
        "certifications", "certification", "certificates", "licenses", "licences", "certificats", "trainings",
        "formations complementaires", "courses", "cours",
    ],
    "languages": ["languages", "language", "langues", "langue", "sprachen"],
    "other": [
        "interests", "hobbies", "centres d'interet", "activites", "activities", "extracurricular activities",
        "volunteering", "benevolat", "vie associative", "awards", "honors", "distinctions", "publications",
        "references", "leadership", "achievements",
    ],
}
MONTHS = {
    "jan": 1, "january": 1, "janv": 1, "janvier": 1, "feb": 2, "february": 2, "fev": 2, "fevr": 2, "fevrier": 2,
    "mar": 3, "march": 3, "mars": 3, "apr": 4, "april": 4, "avr": 4, "avril": 4, "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juin": 6, "jul": 7, "july": 7, "juil": 7, "juillet": 7, "aug": 8, "august": 8,
    "aout": 8, "sep": 9, "sept": 9, "september": 9, "septembre": 9, "oct": 10, "october": 10, "octobre": 10,
    "nov": 11, "november": 11, "novembre": 11, "dec": 12, "december": 12, "decembre": 12,
}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_POINT = rf"(?:(?:({_MONTH})\.?\s+)?(?:([0-9]{{1,2}})\s*/\s*)?((?:19|20)[0-9]{{2}}))"
_PRESENT = r"(present|current|now|today|ongoing|aujourd'hui|actuel|actuellement|en cours|heute|date)"
# Groups: 1 month, 2 month number, 3 year, then 4 to 6 for the end, 7 for an open end.
DATE_RANGE = rf"{_POINT}\s*(?:-|to|a|au|until|jusqu'a|bis)\s*(?:{_POINT}|{_PRESENT})"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
DURATION = r"\(?\b([0-9]{1,2})\s*(?:months?|mois|monate)\b"
INTERN = (
    r"(?m)\b(intern|internship|stagiaire|pfe|pfa|apprenti|apprentice|alternance|alternant|werkstudent|praktikum|trainee)\b"
    r"|\bstage\s+(?:de|d'|pfe|pfa|ingenieur|technicien|ouvrier|d'ete|en)\b|^\s*stage\b"
)
STUDENT = r"\b(student|etudiant|etudiante|eleve[- ]ingenieur|final[- ]year|derniere annee|fin d'etudes|undergraduate|graduating)\b"
STUDY_ONGOING = r"\b(expected|en cours|ongoing|present|aujourd'hui|actuellement)\b"
ROLE_WORD = (
    r"\b(engineer|ingenieur|intern|stagiaire|analyst|analyste|developer|developpeur|technician|technicien|manager|"
    r"responsable|consultant|scientist|assistant|lead|head|officer|specialist|coordinator|planner|apprenti)\b"
)
DEGREE_LINE = r"\b(master|bachelor|licence|engineering degree|diplome|ingenieur|cycle|bac|phd|msc|bsc|degree|baccalaureat)\b"
PLACES = [
    "Tunis", "Ariana", "Ben Arous", "La Marsa", "Sfax", "Sousse", "Monastir", "Bizerte", "Nabeul", "Gabes", "Gabès",
    "Kairouan", "Tunisia", "Tunisie", "Paris", "Lyon", "Marseille", "Toulouse", "Lille", "Nantes", "Grenoble",
    "France", "Berlin", "Munich", "Hamburg", "Germany", "Montreal", "Montréal", "Quebec", "Canada", "London", "UK",
    "Brussels", "Belgium", "Geneva", "Switzerland", "Casablanca", "Rabat", "Morocco", "Algiers", "Dubai", "Doha",
    "Madrid", "Barcelona", "Milan", "Amsterdam", "Lisbon",
]
UNIT_CHARS = 420
_ALL = 1_000_000_000


# --- Sections ------------------------------------------------------------------------------------------------
def heading(line: Column) -> Column:
    """struct(section, inline) when the line is a section heading, else null. ``Skills: Python`` carries its
    content inline."""
    names = sorted((h for hs in SECTIONS.values() for h in hs), key=len, reverse=True)
    pattern = rf"^({'|'.join(names)})\s*[:\-|]\s*(.+)$"

    def section_of(name: Column) -> Column:
        out = F
        for sec, hs in SECTIONS.items():
            out = out.when(name.isin(*hs), sec)
        return out

    def found(s: Column, f: Column) -> Column:
        whole = F.struct(section_of(f).alias("section"), F.lit("").alias("inline"))
        part = F.struct(
            section_of(F.regexp_extract(f, pattern, 1)).alias("section"),
            F.trim(F.right(s, F.length(F.regexp_extract(f, pattern, 2)))).alias("inline"),
        )
        return F.when(f.isin(*names), whole).when(f.rlike(pattern), part)

    def short(s: Column) -> Column:
        folded = T.strip_chars(F.regexp_replace(T.fold(s), r"\s+", " "), " :")
        return F.when((s != "") & (F.length(s) <= 60), T.bind(folded, lambda f: found(s, f)))

    return T.bind(T.strip(T.strip_chars(T.strip(line), r"#*_=—:|•-")), short)


def section_rows(cvs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(cv_id, line_no, raw, section, block, row): the lines of each text with the section and the heading they stand under, by gaps and islands.

    A heading without inline content always opens a section. One with inline content opens one too, unless a skills section is open, where it is a
    sub-label; whether one is open is settled by the headings since the last one without inline content, the island of this line. So is an inline
    languages heading whose content names two or more skills ("Languages: Python, SQL"), which needs ``aliases``. ``row`` carries the columns of
    ``cvs`` once, on a line -1 of its own, so that no line is shuffled with its whole document.
    """
    rows = cvs.withColumn("__lines", T.split_lines(F.coalesce("text", F.lit(""))))
    if aliases is not None:
        inline = rows.select("cv_id", F.posexplode_outer(F.transform("__lines", lambda s: F.struct(s.alias("raw"), heading(s).alias("h")))).alias("at", "l")).where(
            "l.h.section = 'languages' and l.h.inline <> ''"
        )
        skilled = (
            tag_mentions(inline.select("cv_id", "at", F.col("l.h.inline").alias("inline")), ["cv_id", "at"], "inline", aliases)
            .groupBy("cv_id", "at")
            .agg(F.countDistinct("skill").alias("n"))
            .where("n >= 2")
            .groupBy("cv_id")
            .agg(F.collect_set("at").alias("__sub"))
        )
        rows = rows.join(skilled, "cv_id", "left")
    else:
        rows = rows.withColumn("__sub", F.lit(None).cast("array<int>"))
    row = F.struct(*cvs.columns)
    nothing = F.lit(None).cast(cvs.schema)
    every = F.concat(
        F.array(F.struct(F.lit(-1).alias("line_no"), F.lit("").alias("raw"), F.lit(False).alias("sub"), row.alias("row"))),
        F.transform(
            "__lines",
            lambda s, i: F.struct(i.alias("line_no"), s.alias("raw"), F.coalesce(F.array_contains("__sub", i), F.lit(False)).alias("sub"), nothing.alias("row")),
        ),
    )
    lines = rows.select("cv_id", explode_once(every).alias("l")).select("cv_id", "l.*").withColumn("h", F.when(F.col("line_no") >= 0, heading(F.col("raw"))))
    lines = lines.withColumns(
        {"plain": F.coalesce(F.col("h.inline") == "", F.lit(False)), "inline": F.coalesce((F.col("h.inline") != "") & ~F.col("sub"), F.lit(False))}
    )
    document = W.partitionBy("cv_id").orderBy("line_no")
    above = document.rowsBetween(W.unboundedPreceding, -1)
    of_skills = (F.col("plain") | F.col("inline")) & (F.col("h.section") == "skills")
    # the last of either above; a line that is plain itself opens a section anyway
    at = lambda c: F.last(F.when(c, F.col("line_no")), ignorenulls=True).over(above)
    in_skills = F.coalesce(at(of_skills) >= F.coalesce(at(F.col("plain")), F.lit(-1)), F.lit(False))
    lines = lines.withColumn("opens", F.col("plain") | (F.col("inline") & ~in_skills))
    section = F.coalesce(F.last(F.when(F.col("opens"), F.col("h.section")), ignorenulls=True).over(document), F.lit("header"))
    raw = F.when(F.col("opens"), F.col("h.inline")).otherwise(F.col("raw")).alias("raw")
    lines = lines.select("cv_id", "line_no", raw, section.alias("section"), F.count_if("opens").over(document).cast("int").alias("block"), "row")
    return lines.where("line_no < 0 or trim(raw) <> ''")


def section_lines(lines: Column, section: str) -> Column:
    return F.transform(F.filter(lines, lambda l: l["section"] == section), lambda l: l["raw"])


def looks_like_meta(line: Column) -> Column:
    """A role, company or date line rather than a sentence."""
    def test(x: Column) -> Column:
        f, words, end = x["f"], x["words"], x["end"]
        n = F.size(words)
        caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return (
            f.rlike(DATE_RANGE)
            | (f.rlike(YEAR) & (n <= 12))
            | (f.contains("|") & (n <= 16))
            | ((n <= 9) & f.rlike(ROLE_WORD) & ~end.endswith("."))
            | ((n <= 6) & ~end.rlike(r"[.;]$") & (caps >= F.greatest(F.lit(1), n - 1)))
        )

    words = F.regexp_extract_all(line, F.lit(r"(\S+)"), F.lit(1))
    return T.bind(F.struct(T.fold(line).alias("f"), words.alias("words"), F.regexp_replace(line, r"\s+$", "").alias("end")), test)


# --- Units -----------------------------------------------------------------------------------------------------
def unit_rows(lines: DataFrame) -> DataFrame:
    """``section_rows`` with ``unit``, the number of the evidence unit that the line belongs to (null: none), ``opens_unit``, ``piece``, what the line adds to its text, ``context``
    and ``entry``: whether an experience entry starts here.

    Every state of a section is the last line that sets it, so each is one window over the lines of the block. A unit of work is open after a bullet
    or a sentence of six words, closed after a role line, and left as it was by a short line that continues. An education entry has a year after a line
    with one, and has none after a degree line without one.
    """
    content = (F.col("line_no") >= 0) & (F.col("section") != "header")
    x = lines.withColumn("b", T.bullet_parts(F.col("raw")))
    x = x.select(*lines.columns, F.col("b.is_bullet").alias("is_bullet"), F.when(content & (F.col("b.text") != ""), F.col("b.text")).alias("body"))
    body = F.col("body")
    x = x.withColumns(
        {
            "meta": F.when(content, looks_like_meta(F.coalesce("body", F.lit("")))), "words": T.word_count(body), "lower": body.rlike(r"^\p{Ll}"),
            "year": body.rlike(YEAR), "starts": body.rlike(YEAR) | T.fold(body).rlike(DEGREE_LINE),
        }
    )

    # all windows share one order, so lines are sorted once; blocks, and roles within them, follow each other, and what an earlier one set is left out
    document = W.partitionBy("cv_id").orderBy("line_no")
    before = document.rowsBetween(W.unboundedPreceding, -1)

    def last(c: Column, *within: str) -> Column:
        """The value of the last line above that sets it, in the block of this line."""
        places = ("block", *within)
        found = F.last(F.when(c.isNotNull(), F.struct(*places, c.alias("v"))), ignorenulls=True).over(before)
        same = found[places[0]] == F.col(places[0])
        for p in within:
            same = same & (found[p] == F.col(p))
        return F.when(same, found["v"])

    def state(c: Column) -> Column:
        """The value of the last line that sets it; lines without text set nothing."""
        return F.coalesce(last(F.when(F.col("body").isNotNull(), c)), F.lit(False))

    x = x.withColumn("prev", last(F.col("body")))
    prev, bullet, meta = F.col("prev"), F.col("is_bullet"), F.col("meta")
    # with \s* before the end: white space there does not count
    runs = F.col("lower") | ~prev.rlike(r"[.!?;]\s*$")
    opened = F.when(bullet, F.lit(True)).when(meta, F.lit(False)).when(F.col("words") >= 6, F.lit(True)).when(~runs, F.lit(False))
    dated = F.when(F.col("year"), F.lit(True)).when(F.col("starts"), F.lit(False))
    x = x.withColumns({"runs": F.coalesce(runs, F.lit(False)), "opened": opened, "dated": dated, "prev_year": prev.rlike(YEAR)})
    x = x.withColumns({"was_open": state(F.col("opened")), "was_dated": state(F.col("dated"))})

    goes_on = ~bullet & ~meta & F.col("was_open") & F.col("runs")
    is_role = ~bullet & ~goes_on & (meta | (F.col("words") < 6))
    joins = prev.isNotNull() & (prev.rlike(r"[,/&-]\s*$") | F.col("lower") | F.col("body").startswith("("))
    new_entry = prev.isNull() | (F.col("starts") & F.col("was_dated"))
    wraps = ~F.col("prev_year") & ~prev.rlike(r"[.;:)]\s*$")
    section = F.col("section")
    work = section.isin("experience", "projects")
    whole = section.isin("summary", "languages")
    new = (
        F.when(work, bullet | (~goes_on & ~is_role))
        .when(section == "skills", ~joins)
        .when(section == "education", new_entry)
        .when(whole, prev.isNull())
        .otherwise(F.col("words") >= 3)
    )
    more = F.when(work, goes_on).when(section == "skills", joins).when(section == "education", ~new_entry).when(whole, prev.isNotNull()).otherwise(F.lit(False))
    has_text = F.col("body").isNotNull()
    renews = ~bullet & ~goes_on & meta & F.col("was_open")
    x = x.withColumns({k: has_text & F.coalesce(c, F.lit(False)) for k, c in {"opens_unit": new, "more": more, "role": work & is_role, "renews": work & renews}.items()})
    glue = F.when(section == "languages", "; ").when((section == "education") & ~wraps, " — ").otherwise(" ")
    piece = F.when(F.col("opens_unit"), body).when(F.col("more"), F.concat(glue, "body"))

    # the last two role lines since the roles were renewed
    x = x.withColumns({"piece": piece, "roles": F.count_if("renews").over(document)})
    x = x.withColumn("pair", F.when(F.col("role"), F.struct(last(F.when(F.col("role"), F.col("body")), "roles").alias("a"), F.col("body").alias("b"))))
    above = last(F.col("pair"), "roles")
    context = F.when(work, F.concat_ws(" | ", above["a"], above["b"])).otherwise("")

    at_work = section == "experience"
    role_above = F.last(F.when(at_work, meta & ~bullet), ignorenulls=True).over(before)
    entry = at_work & meta & ~bullet & ~F.coalesce(role_above, F.lit(True))
    number = F.when(F.col("opens_unit") | F.col("more"), F.count_if("opens_unit").over(document))
    return x.select(*lines.columns, "opens_unit", "piece", number.alias("unit"), context.alias("context"), F.coalesce(entry, F.lit(False)).alias("entry"))


def segment(cvs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``cvs`` with ``lines``: array of struct(section, block, raw, entry), headings left out, and ``units``: array of struct(unit_no, unit_id,
    section, text, context, kind). One shuffle by ``cv_id`` serves all windows and both aggregates, and the work is linear in the lines of a text.

    A text with fewer than three units becomes its lines of five words and more, but for the first. Long units are packed into sentence groups.
    """
    x = unit_rows(section_rows(cvs, aliases))
    kind = F.when(F.col("section").isin("experience", "projects"), "bullet").when(F.col("section").isin("skills", "education", "summary", "languages"), F.col("section")).otherwise("line")
    line = F.struct("line_no", F.struct("section", "block", "raw", "entry").alias("l"))
    unit = F.struct("section", "context", kind.alias("kind"))
    of_unit = x.groupBy("cv_id", "unit").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.collect_list(F.when(F.col("line_no") >= 0, line)).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("line_no", "piece")))).alias("pieces"),
        F.first(F.when(F.col("opens_unit"), unit), ignorenulls=True).alias("u"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    made = F.when(F.col("unit").isNotNull(), F.struct("unit", F.col("u.section").alias("section"), text.alias("text"), F.col("u.context").alias("context"), F.col("u.kind").alias("kind")))
    whole = of_unit.select("cv_id", "row", "lines", made.alias("made")).groupBy("cv_id").agg(
        F.first("row", ignorenulls=True).alias("row"), F.flatten(F.collect_list("lines")).alias("lines"), F.collect_list("made").alias("made")
    )
    out = whole.select("row.*", F.transform(F.array_sort("lines"), lambda l: l["l"]).alias("lines"), F.array_sort("made").alias("__made"))
    return _with_units(out, cvs.columns)


def _with_units(out: DataFrame, columns: list[str]) -> DataFrame:
    solid = F.filter("__made", lambda u: (u["kind"] != "skills") | (F.length(u["text"]) >= 2))
    raw = F.transform(solid, lambda u: F.struct(u["section"].alias("section"), u["text"].alias("text"), u["context"].alias("context"), u["kind"].alias("kind")))
    lines = T.split_lines(F.coalesce("text", F.lit("")))
    loose = F.filter(F.transform(F.slice(lines, 2, _ALL), lambda s: T.bullet_parts(s)["text"]), lambda s: T.word_count(s) >= 5)
    fallback = F.transform(
        loose, lambda s: F.struct(F.lit("other").alias("section"), s.alias("text"), F.lit("").alias("context"), F.lit("line").alias("kind"))
    )

    def packs(units: Column) -> Column:
        return F.flatten(
            F.transform(
                units,
                lambda u: F.transform(
                    pack_sentences(F.trim(u["text"]), UNIT_CHARS),
                    lambda t: F.struct(u["section"].alias("section"), t.alias("text"), u["context"].alias("context"), u["kind"].alias("kind")),
                ),
            )
        )

    out = out.withColumn("__raw", raw).withColumn("__packed", packs(F.col("__raw")))
    # a summary counts by its sentence groups, other units as they are
    found = F.size(F.filter("__raw", lambda u: u["kind"] != "summary")) + F.size(F.filter("__packed", lambda u: u["kind"] == "summary"))
    kept = F.filter(F.when(found < 3, packs(fallback)).otherwise(F.col("__packed")), lambda u: F.length(u["text"]) >= 3)
    numbered = F.transform(
        kept,
        lambda u, i: F.struct(
            (i + 1).cast("int").alias("unit_no"), F.concat(F.lit("E"), (i + 1).cast("string")).alias("unit_id"),
            u["section"].alias("section"), u["text"].alias("text"), u["context"].alias("context"), u["kind"].alias("kind"),
        ),
    )
    return out.select(*columns, "lines", numbered.alias("units"))


def unit_table(with_units: DataFrame) -> DataFrame:
    """(cv_id, unit_no, unit_id, section, text, context, kind)."""
    return with_units.select("cv_id", F.explode_outer("units").alias("u")).where("u is not null").select("cv_id", "u.*")


def section_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("section").agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct("cv_id").alias("n_cvs"))


def quality_gate(with_units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects(cv_id, reason)): too little text or fewer than two units."""
    dense = F.length(F.regexp_replace("text", r"\s", ""))
    reason = (
        F.when(dense < 200, "almost no text").when(F.length("text") < 200, "text too short").when(F.size("units") < 2, "no evidence lines")
    )
    marked = with_units.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("cv_id", "reason")


# --- Experience ------------------------------------------------------------------------------------------------
_ENTRY = "\x1e"


def experience_entries(lines: Column) -> Column:
    """Array of entries (arrays of lines) of the ``lines`` of ``segment``: a role line after body text starts a new entry."""
    mine = F.filter(lines, lambda l: l["section"] == "experience")
    marked = F.transform(mine, lambda l: F.concat(F.when(l["entry"], F.lit(_ENTRY)).otherwise(F.lit("")), F.translate(l["raw"], _ENTRY, " ")))
    entries = F.transform(F.split(F.array_join(marked, "\n"), f"\n{_ENTRY}"), lambda e: F.split(e, "\n"))
    return F.when(F.size(mine) > 0, entries).otherwise(F.array().cast("array<array<string>>"))


def _month_index(m: Column, month: int, number: int, year: int) -> Column:
    name = F.regexp_extract(m, DATE_RANGE, month)
    value = F
    for i in range(1, 13):
        value = value.when(name.isin(*[k for k, v in MONTHS.items() if v == i]), F.lit(i))
    digits = F.regexp_extract(m, DATE_RANGE, number)
    as_number = F.when(digits != "", F.greatest(F.lit(1), F.least(F.lit(12), digits.cast("int"))))
    y = F.regexp_extract(m, DATE_RANGE, year)
    return F.when(y != "", y.cast("int") * 12 + F.coalesce(F.when(name != "", value), as_number, F.lit(1)) - 1)


def date_ranges(folded: Column, as_of: date) -> Column:
    """Array of half-open month intervals struct(a, b). A pair of bare years runs from mid-year to mid-year."""
    now = as_of.year * 12 + as_of.month - 1
    matches = F.transform(F.regexp_extract_all(folded, F.lit(f"({DATE_RANGE})"), F.lit(1)), lambda m: F.struct(m.alias("m")))

    def parse(x: Column) -> Column:
        m = x["m"]
        open_end = F.regexp_extract(m, DATE_RANGE, 7) != ""
        a, b = _month_index(m, 1, 2, 3), F.when(open_end, F.lit(now)).otherwise(_month_index(m, 4, 5, 6))
        bare = (F.regexp_extract(m, DATE_RANGE, 1) == "") & (F.regexp_extract(m, DATE_RANGE, 2) == "")
        bare_end = ~open_end & (F.regexp_extract(m, DATE_RANGE, 4) == "") & (F.regexp_extract(m, DATE_RANGE, 5) == "")
        a2 = F.when(bare, a + 6).otherwise(a)
        b2 = F.when(bare & bare_end, F.when(b + 5 < a + 6, a + 11).otherwise(b + 5)).otherwise(b)
        return F.struct(a2.alias("a"), F.when(b2 >= a2, F.least(b2, F.lit(now)) + 1).alias("b"))

    return F.filter(F.transform(matches, parse), lambda r: r["b"].isNotNull())


def union_months(ranges: Column) -> Column:
    """Number of months covered by the intervals together."""
    forward = F.filter(ranges, lambda r: r["a"] < r["b"])
    return F.size(F.array_distinct(F.flatten(F.transform(forward, lambda r: F.sequence(r["a"], r["b"] - 1)))))


def covered_months(intervals: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, months): union length of half-open month intervals held as rows. Months are a small domain, so the
    distinct (key, month) pairs are combined before the shuffle and one hot key stays cheap."""
    months = intervals.where(F.col(a) < F.col(b)).select(*keys, F.explode(F.sequence(F.col(a), F.col(b) - 1)).alias("month"))
    return months.groupBy(*keys).agg(F.countDistinct("month").alias("months"))


def experience_months(sectioned: DataFrame, as_of: date) -> DataFrame:
    """``sectioned`` plus ``years_experience`` and ``internship_months``. Undated entries count by their stated
    number of months; those all start at month zero, so they overlap."""
    entries = F.transform(
        experience_entries(F.col("lines")), lambda e: T.fold(F.array_join(e, "\n"))
    )
    out = sectioned.withColumn("__entries", entries)
    stated = F.transform(
        "__entries",
        lambda e: F.struct(
            e.rlike(INTERN).alias("intern"),
            date_ranges(e, as_of).alias("dated"),
            F.regexp_extract(e, "(?i)" + DURATION, 1).alias("months"),
        ),
    )
    ranges = F.transform(
        stated,
        lambda e: F.struct(
            e["intern"].alias("intern"),
            F.when(F.size(e["dated"]) > 0, e["dated"])
            .when(e["months"] != "", F.array(F.struct(F.lit(0).alias("a"), e["months"].cast("int").alias("b"))))
            .otherwise(F.array().cast("array<struct<a:int,b:int>>"))
            .alias("r"),
        ),
    )
    out = out.withColumn("__ranges", ranges)

    def months(intern: bool) -> Column:
        mine = F.filter("__ranges", lambda e: e["intern"] == F.lit(intern))
        return union_months(F.flatten(F.transform(mine, lambda e: e["r"])))

    return (
        out.withColumn("years_experience", F.bround(months(False) / 12, 1))
        .withColumn("internship_months", months(True))
        .drop("__entries", "__ranges")
    )


# --- Profile ---------------------------------------------------------------------------------------------------
def skill_counts(mentions: DataFrame, owner: str = "cv_id") -> DataFrame:
    """(owner, skills): skills by falling mention count, then name."""
    return (
        mentions.groupBy(owner, "skill")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(owner)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "skill"))).alias("s"))
        .select(owner, F.transform("s", lambda x: x["skill"]).alias("skills"))
    )


def header_facts(header: Column, places: list[str] = PLACES) -> tuple[Column, Column]:
    """(headline, location) from the lines above the first section."""
    any_place = "(?i)" + "|".join(places)
    lines = F.filter(F.transform(header, lambda s: F.trim(s)), lambda s: s != "")
    title = F.filter(
        F.slice(lines, 1, 5),
        lambda s: ~s.rlike(r"[\[@]") & (F.length(s) >= 4) & ~(F.lower(s).rlike(any_place.lower()) & (T.word_count(s) <= 4)),
    )
    order = F.array(*[F.lit(p) for p in places])
    pattern = rf"(?<![{T.WORD_CHAR}])({'|'.join(places)})(?![{T.WORD_CHAR}])"

    def place_of(s: Column) -> Column:
        ranks = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda p: F.array_position(order, p))
        return F.array_min(ranks)

    ranks = F.filter(F.transform(F.slice(lines, 1, 6), place_of), lambda r: r.isNotNull())
    place = F.element_at(order, F.get(ranks, F.lit(0)).cast("int"))
    return F.coalesce(F.get(title, F.lit(0)), F.lit("")), F.coalesce(place, F.lit(""))


def family_scores(skills: Column, text: Column) -> Column:
    """Array of struct(family, family_no, score): matching signal skills, plus two per title in the text."""
    folded = T.fold(text)
    out = []
    for i, family in enumerate(R.FAMILIES, 1):
        score = F.size(F.array_intersect(skills, F.array(*[F.lit(s) for s in family.signals])))
        for t in (*family.titles, *family.synonyms):
            score = score + 2 * folded.rlike(rf"(?<![{T.WORD_CHAR}]){_plain(t)}").cast("int")
        out.append(F.struct(F.lit(family.name).alias("family"), F.lit(i).alias("family_no"), score.alias("score")))
    return F.array(*out)


def _plain(title: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c)).lower()


def candidate_seniority(student: Column, years: Column) -> Column:
    return (
        F.when(student & (years < 1), "student")
        .when(years < 2, "junior")
        .when(years < 5, "mid")
        .when(years < 9, "senior")
        .otherwise("lead")
    )


def build_profiles(with_units: DataFrame, skills: DataFrame, as_of: date) -> DataFrame:
    """One profile row per candidate from ``segment`` output and ``skill_counts``."""
    x = experience_months(with_units, as_of).join(skills, "cv_id", "left")
    x = x.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    headline, location = header_facts(section_lines(F.col("lines"), "header"))
    x = x.withColumn("headline", headline).withColumn("location", location)
    of_section = lambda name: F.filter("units", lambda u: u["section"] == name)
    summary = F.array_join(F.transform(of_section("summary"), lambda u: u["text"]), " ")
    x = x.withColumn("__intro", F.concat_ws(" ", "headline", summary))
    x = x.withColumn("family_scores", family_scores(F.col("skills"), F.col("__intro")))
    ranked = F.slice(
        F.array_sort(
            F.transform(
                F.filter("family_scores", lambda f: f["score"] > 0),
                lambda f: F.struct((-f["score"]).alias("neg"), f["family_no"].alias("family_no"), f["family"].alias("family")),
            )
        ),
        1,
        3,
    )
    titles = F.array(*[F.array(*[F.lit(t) for t in family.titles]) for family in R.FAMILIES])
    labels = F.array(*[F.lit(family.label) for family in R.FAMILIES])
    x = x.withColumn("__top", ranked)
    top_titles = F.flatten(F.transform(F.slice("__top", 1, 2), lambda f: F.element_at(titles, f["family_no"])))
    study = T.fold(F.array_join(section_lines(F.col("lines"), "education"), "\n"))
    later = F.exists(
        F.regexp_extract_all(study, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)),
        lambda y: (y.cast("int") > as_of.year) | ((y.cast("int") == as_of.year) & F.lit(as_of.month < 7)),
    )
    student = T.fold(F.col("__intro")).rlike(STUDENT) | study.rlike(STUDY_ONGOING) | later
    own = F.array_join(section_lines(F.col("lines"), "languages"), "\n")
    levels = language_levels(F.when(own != "", own).otherwise(F.col("text")))
    return x.select(
        "cv_id",
        "headline",
        F.when(F.size(top_titles) > 0, top_titles).otherwise(F.array(F.lit("engineer"))).alias("target_titles"),
        "skills",
        F.transform("__top", lambda f: F.element_at(labels, f["family_no"])).alias("domains"),
        "family_scores",
        "years_experience",
        "internship_months",
        candidate_seniority(student, F.col("years_experience")).alias("seniority"),
        levels.alias("languages"),
        F.slice(F.transform(of_section("education"), lambda u: u["text"]), 1, 4).alias("education"),
        "location",
        language_of(F.col("text")).alias("cv_language"),
        F.lit("rules").alias("source"),
    )


def merge_profiles(profiles: DataFrame, extra: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Merge an external profile table: its titles, domains and headline win when given, skills are united,
    the higher language level counts, and dates found in the document win over stated years. Family scores follow the merged skills and headline.

    ``canonical(term, skill)`` maps outside skill names to the vocabulary (see ``canonicalise``).
    """
    none = F.array().cast("array<string>")
    more = extra.select("cv_id", F.posexplode_outer("skills").alias("at", "term")).where("term is not null and trim(term) <> ''")
    if canonical is not None:
        more = more.join(canonical.withColumnRenamed("skill", "__c"), F.trim(F.col("term")) == canonical["term"], "left").select(
            "cv_id", "at", F.coalesce("__c", F.trim(more["term"])).alias("term")
        )
    more_skills = more.groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct("at", F.trim("term").alias("term")))).alias("s"))
    more_skills = more_skills.select("cv_id", F.transform("s", lambda x: x["term"]).alias("__skills"))
    word = lambda s: F.lower(F.trim(s))
    level = lambda s: F.when(word(s) == "native", 5).when(word(s).isin("fluent", "advanced"), 4).when(word(s) == "basic", 1).otherwise(3)
    name = lambda l: F.coalesce(F.get(language_hits(l["name"]), F.lit(0))["lang"], F.initcap(F.trim(l["name"])))
    given_levels = F.transform(F.coalesce("x.languages", F.array().cast("array<struct<name:string,level:string>>")), lambda l: F.struct(name(l).alias("name"), level(l["level"]).alias("level")))
    # a language that is listed twice counts with its higher level
    named = lambda ls: F.array_distinct(F.transform(ls, lambda l: l["name"]))
    highest = lambda ls: F.transform(named(ls), lambda n: F.array_max(F.transform(F.filter(ls, lambda l: l["name"] == n), lambda l: l["level"])))
    outside = F.map_from_arrays(named(given_levels), highest(given_levels))
    x = profiles.alias("p").join(extra.alias("x"), "cv_id").join(more_skills, "cv_id", "left")
    dated = (F.col("p.years_experience") > 0) | (F.col("p.internship_months") > 0)
    levels = ("student", "junior", "mid", "senior", "lead")

    def given(c: str) -> Column:
        return F.nullif(F.trim(f"x.{c}"), F.lit(""))

    def given_list(c: str, n: int) -> Column:
        kept = F.slice(F.filter(F.coalesce(f"x.{c}", none), lambda t: F.trim(t) != ""), 1, n)
        return F.when(F.size(kept) > 0, kept).otherwise(F.col(f"p.{c}"))

    merged = x.select(
        "cv_id",
        F.coalesce(given("headline"), "p.headline").alias("headline"),
        given_list("target_titles", 5).alias("target_titles"),
        F.array_distinct(F.concat("p.skills", F.coalesce("__skills", none))).alias("skills"),
        given_list("domains", 4).alias("domains"),
        F.lit(None).cast(profiles.schema["family_scores"].dataType).alias("family_scores"),
        F.when(dated, F.col("p.years_experience")).otherwise(F.coalesce("x.years_experience", F.lit(0.0))).alias("years_experience"),
        "p.internship_months",
        F.when(F.col("x.seniority").isin(*levels), F.col("x.seniority")).otherwise(F.col("p.seniority")).alias("seniority"),
        F.map_zip_with("p.languages", outside, lambda k, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))).alias("languages"),
        "p.education",
        F.coalesce(F.nullif("p.location", F.lit("")), "x.location").alias("location"),
        "p.cv_language",
        F.lit("external").alias("source"),
    )
    merged = merged.withColumn("family_scores", family_scores(F.col("skills"), F.coalesce("headline", F.lit(""))))
    return merged.unionByName(profiles.join(extra.select("cv_id"), "cv_id", "left_anti").select(*merged.columns))


def family_score_table(profiles: DataFrame) -> DataFrame:
    """(cv_id, family, family_no, score) by which searches are planned: from the headline and skills that a profile has now, merged ones
    included. A summary counts for the profile's own ``family_scores`` only."""
    scores = family_scores(F.col("skills"), F.coalesce("headline", F.lit("")))
    return profiles.select("cv_id", F.explode(scores).alias("f")).select("cv_id", "f.*")


def prepare(cvs: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Redact, assign sections and build units in one go; ``n_*`` columns carry the redaction counts."""
    clean = cvs.select("cv_id", T.clean_text(F.col("text")).alias("text"))
    known = None
    if aliases is not None:
        found = name_candidates(clean, ["cv_id"], "text")
        known = tag_mentions(found, ["cv_id", "line"], "line", aliases).select("cv_id", "line").distinct()
    return segment(redact(clean, "text", known, ["cv_id"]), aliases)
