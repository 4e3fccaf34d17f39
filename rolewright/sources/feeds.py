"""Landed feed payloads to postings: one row per file or response in, one row per posting out.

Each reader takes a table with the response text (``payload``) and, for company boards, the board ``slug``.
Schemas are given, never inferred.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..schemas import POSTING_COLUMNS, as_postings

GREENHOUSE = (
    "jobs array<struct<id: string, title: string, location: struct<name: string>, absolute_url: string, updated_at: string, "
    "first_published: string, content: string, departments: array<struct<name: string>>>>"
)
LEVER = (
    "array<struct<id: string, text: string, categories: struct<location: string, allLocations: array<string>, team: string, "
    "department: string, commitment: string>, workplaceType: string, hostedUrl: string, createdAt: string, "
    "descriptionPlain: string, description: string, lists: array<struct<text: string, content: string>>, additionalPlain: string>>"
)
ASHBY = (
    "jobs array<struct<id: string, title: string, location: string, isListed: boolean, isRemote: boolean, workplaceType: string, "
    "descriptionPlain: string, descriptionHtml: string, jobUrl: string, publishedAt: string, department: string, team: string, "
    "employmentType: string>>"
)
REMOTIVE = (
    "jobs array<struct<id: string, url: string, title: string, company_name: string, category: string, job_type: string, "
    "publication_date: string, candidate_required_location: string, description: string>>"
)
ARBEITNOW = (
    "data array<struct<slug: string, company_name: string, title: string, description: string, remote: boolean, url: string, "
    "tags: array<string>, job_types: array<string>, location: string, created_at: string>>"
)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _kept(*cols: str) -> Column:
    return F.filter(F.array(*[F.col(c) for c in cols]), lambda t: t.isNotNull() & (t != ""))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalise_greenhouse(raw: DataFrame) -> DataFrame:
    """``raw(slug, payload[, board_name])``. The company is the board name, else the slug in title case."""
    name = F.col("board_name") if "board_name" in raw.columns else F.lit(None).cast("string")
    j = raw.select(
        "slug",
        F.coalesce(_blank_to_null(name), T.title_case_slug(F.col("slug"))).alias("company"),
        F.explode(F.from_json("payload", GREENHOUSE)["jobs"]).alias("j"),
    ).select("slug", "company", "j.*")
    return as_postings(
        j.select(
            F.concat_ws(":", F.lit("greenhouse"), "slug", "id").alias("job_id"),
            F.lit("greenhouse").alias("source"),
            F.lit("Greenhouse").alias("source_label"),
            "company",
            F.trim(_text("title")).alias("title"),
            _text("location.name").alias("location"),
            T.workplace(F.col("location.name")).alias("workplace"),
            _text("absolute_url").alias("url"),
            F.coalesce(_blank_to_null(F.col("first_published")), "updated_at").alias("posted_at"),
            T.html_to_text(F.col("content")).alias("description"),
            F.filter(
                F.transform(F.coalesce("departments", F.array().cast("array<struct<name: string>>")), lambda d: d["name"]),
                lambda n: n.isNotNull() & (n != ""),
            ).alias("tags"),
            F.concat("company", F.lit(" careers (Greenhouse)")).alias("attribution"),
        )
    )


def normalise_lever(raw: DataFrame) -> DataFrame:
    """``raw(slug, payload)``. The description is the plain text, each titled list and the closing text."""
    j = raw.select("slug", F.explode(F.from_json("payload", LEVER)).alias("j")).select("slug", "j.*")
    lists = F.transform(
        F.coalesce("lists", F.array().cast("array<struct<text: string, content: string>>")),
        lambda x: F.when(
            F.trim(F.coalesce(x["text"], F.lit(""))) != "", F.concat_ws("\n", F.trim(x["text"]), T.html_to_text(x["content"]))
        ).otherwise(T.html_to_text(x["content"])),
    )
    head = F.coalesce(_blank_to_null(F.col("descriptionPlain")), T.html_to_text(F.col("description")))
    parts = F.concat(F.array(head), lists, F.array("additionalPlain"))
    location = F.coalesce(_blank_to_null(F.col("categories.location")), F.array_join("categories.allLocations", ", "), F.lit(""))
    kind = F.replace(_text("workplaceType"), F.lit("on-site"), F.lit("onsite"))
    company = T.title_case_slug(F.col("slug"))
    return as_postings(
        j.withColumn("loc", location).select(
            F.concat_ws(":", F.lit("lever"), "slug", "id").alias("job_id"),
            F.lit("lever").alias("source"),
            F.lit("Lever").alias("source_label"),
            company.alias("company"),
            F.trim(_text("text")).alias("title"),
            F.col("loc").alias("location"),
            F.when(kind.isin("remote", "hybrid", "onsite"), kind).otherwise(T.workplace(F.col("loc"))).alias("workplace"),
            _text("hostedUrl").alias("url"),
            F.col("createdAt").alias("posted_at"),
            T.clean_text(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")).alias("description"),
            _kept("categories.team", "categories.department", "categories.commitment").alias("tags"),
            F.concat(company, F.lit(" careers (Lever)")).alias("attribution"),
        )
    )


def normalise_ashby(raw: DataFrame) -> DataFrame:
    """``raw(slug, payload)``. Unlisted postings are dropped; the id falls back to the end of the URL."""
    j = (
        raw.select("slug", F.explode(F.from_json("payload", ASHBY)["jobs"]).alias("j"))
        .select("slug", "j.*")
        .where(F.coalesce("isListed", F.lit(True)))
    )
    kind = F.lower(_text("workplaceType"))
    last = F.element_at(F.split(F.regexp_replace(_text("jobUrl"), "/+$", ""), "/"), -1)
    plain = T.clean_text(F.col("descriptionPlain"))
    company = T.title_case_slug(F.col("slug"))
    return as_postings(
        j.select(
            F.concat_ws(":", F.lit("ashby"), "slug", F.coalesce(_blank_to_null(F.col("id")), last)).alias("job_id"),
            F.lit("ashby").alias("source"),
            F.lit("Ashby").alias("source_label"),
            company.alias("company"),
            F.trim(_text("title")).alias("title"),
            _text("location").alias("location"),
            F.when(kind.isin("remote", "hybrid", "onsite"), kind)
            .otherwise(T.workplace(F.col("location"), F.col("isRemote")))
            .alias("workplace"),
            _text("jobUrl").alias("url"),
            F.col("publishedAt").alias("posted_at"),
            F.coalesce(_blank_to_null(plain), T.html_to_text(F.col("descriptionHtml"))).alias("description"),
            _kept("department", "team", "employmentType").alias("tags"),
            F.concat(company, F.lit(" careers (Ashby)")).alias("attribution"),
        )
    )


def normalise_remotive(raw: DataFrame) -> DataFrame:
    """``raw(payload)``: every posting is remote, with its region in the location."""
    j = raw.select(F.explode(F.from_json("payload", REMOTIVE)["jobs"]).alias("j")).select("j.*")
    loc = F.coalesce(_blank_to_null(F.col("candidate_required_location")), F.lit("Remote"))
    return as_postings(
        j.select(
            F.concat_ws(":", F.lit("remotive"), "id").alias("job_id"),
            F.lit("remotive").alias("source"),
            F.lit("Remotive").alias("source_label"),
            F.coalesce(_blank_to_null(F.col("company_name")), F.lit("Unknown company")).alias("company"),
            F.trim(_text("title")).alias("title"),
            F.when(F.lower(loc).contains("remote"), loc).otherwise(F.concat(F.lit("Remote ("), loc, F.lit(")"))).alias("location"),
            F.lit("remote").alias("workplace"),
            _text("url").alias("url"),
            F.col("publication_date").alias("posted_at"),
            T.html_to_text(F.col("description")).alias("description"),
            _kept("category", "job_type").alias("tags"),
            F.lit("Job via Remotive (remotive.com)").alias("attribution"),
        )
    )


def normalise_arbeitnow(raw: DataFrame) -> DataFrame:
    """``raw(payload)``: one row per result page; an empty page adds nothing."""
    j = raw.select(F.explode(F.from_json("payload", ARBEITNOW)["data"]).alias("j")).select("j.*")
    remote = F.coalesce("remote", F.lit(False))
    loc = _text("location")
    none = F.array().cast("array<string>")
    return as_postings(
        j.select(
            F.concat_ws(":", F.lit("arbeitnow"), "slug").alias("job_id"),
            F.lit("arbeitnow").alias("source"),
            F.lit("Arbeitnow").alias("source_label"),
            F.coalesce(_blank_to_null(F.col("company_name")), F.lit("Unknown company")).alias("company"),
            F.trim(_text("title")).alias("title"),
            F.when(remote & (loc != ""), F.concat(loc, F.lit(" (remote)")))
            .when(remote, "Remote")
            .otherwise(loc)
            .alias("location"),
            F.when(remote, "remote").otherwise("onsite").alias("workplace"),
            _text("url").alias("url"),
            F.col("created_at").alias("posted_at"),
            T.html_to_text(F.col("description")).alias("description"),
            F.concat(F.coalesce("tags", none), F.coalesce("job_types", none)).alias("tags"),
            F.lit("Job via Arbeitnow (arbeitnow.com)").alias("attribution"),
        )
    )


# --- Board specifications ------------------------------------------------------------------------------------
# Where the board name sits in a careers URL, and the order in which boards are tried.
BOARD_URLS = (
    ("greenhouse", r"(?i)(?:job-)?boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?(?:embed/job_board\?for=)?([^/?#&]+)"),
    ("lever", r"(?i)jobs(?:\.eu)?\.lever\.co/([^/?#]+)"),
    ("lever", r"(?i)api(?:\.eu)?\.lever\.co/v0/postings/([^/?#]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([^/?#]+)"),
    ("ashby", r"(?i)api\.ashbyhq\.com/posting-api/job-board/([^/?#]+)"),
)
BOARD_ORDER = ("greenhouse", "lever", "ashby")


def parse_board_specs(specs: DataFrame, col: str = "raw") -> DataFrame:
    """(raw, ats, slug, valid) from a plain name, ``ats:name`` or a careers URL; ats is null for a plain name."""
    s = F.regexp_replace(F.trim(col), "/+$", "")
    by_url = [(ats, F.regexp_extract(s, pat, 1)) for ats, pat in BOARD_URLS]
    prefixed = F.regexp_extract(s, rf"(?i)^({'|'.join(BOARD_ORDER)}):", 1)
    ats, slug = F, F
    for name, got in by_url:
        ats, slug = ats.when(got != "", F.lit(name)), slug.when(got != "", got)
    ats = ats.when(prefixed != "", F.lower(prefixed))
    slug = slug.when(prefixed != "", F.trim(F.regexp_replace(s, r"^[^:]+:", ""))).otherwise(s)
    return specs.select(F.col(col).alias("raw"), ats.alias("ats"), slug.alias("slug")).withColumn(
        "valid", F.col("slug").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,80}$")
    )


def resolve_boards(specs: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of each requested board. A plain name takes the first system, in order, that has postings."""
    tried = F.array_position(F.array(*[F.lit(a) for a in BOARD_ORDER]), F.col("source"))
    known = postings.where(F.col("source").isin(*BOARD_ORDER)).withColumn("board", F.split("job_id", ":")[1])
    boards = known.select("source", "board").distinct()
    wanted = parse_board_specs(specs).where("valid")
    match = (
        wanted.join(boards, (wanted["slug"] == boards["board"]) & (F.coalesce("ats", "source") == F.col("source")))
        .withColumn("rn", F.row_number().over(W.partitionBy("raw").orderBy(tried)))
        .where("rn = 1")
        .select("source", "board")
        .distinct()
    )
    return known.join(match, ["source", "board"], "left_semi").select(*postings.columns)


def unresolved_boards(specs: DataFrame, postings: DataFrame) -> DataFrame:
    """(raw, reason) for specs that name no valid board or a board without postings."""
    found = resolve_boards(specs, postings).select(F.split("job_id", ":")[1].alias("slug")).distinct()
    parsed = parse_board_specs(specs)
    bad = parsed.where("not valid").select("raw", F.lit("not a valid board name").alias("reason"))
    empty = parsed.where("valid").join(found, "slug", "left_anti").select("raw", F.lit("no open postings found").alias("reason"))
    return bad.unionByName(empty)


# --- Pool ----------------------------------------------------------------------------------------------------
def merge_pool(*feeds: DataFrame, seq: str = "ingest_seq", key: str = "job_id") -> DataFrame:
    """Union of feeds by id: the last write wins, the first position (``first_seq``) is kept.

    ``max_by`` combines on the map side, so a posting that is sent again and again costs one row per task.
    """
    rows = feeds[0]
    for f in feeds[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    body = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*body), F.struct(F.col(seq), *body)).alias("last"), F.min(seq).alias("first_seq"))
        .select(key, "last.*", "first_seq")
    )


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    out = feeds[0].select(*POSTING_COLUMNS)
    for f in feeds[1:]:
        out = out.unionByName(f.select(*POSTING_COLUMNS))
    return out
