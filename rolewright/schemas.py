"""Explicit schemas of the tables that cross a boundary."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING = (
    "job_id string, source string, source_label string, company string, title string, location string, workplace string, "
    "url string, posted_at string, description string, tags array<string>, attribution string"
)
POSTING_COLUMNS = tuple(part.strip().split(" ")[0] for part in POSTING.split(","))
CV = "cv_id string, text string"
CAPTURE = (
    "url string, title string, company string, location string, top string, description string, page_text string, selection string"
)
VERDICT = (
    "cv_id string, job_id string, req_no int, verdict string, evidence_ids array<string>, note string, cv_term string, jd_term string"
)
PROFILE_EXTRA = (
    "cv_id string, headline string, target_titles array<string>, skills array<string>, domains array<string>, "
    "years_experience double, seniority string, languages array<struct<name: string, level: string>>, location string"
)

WORKPLACES = ("remote", "hybrid", "onsite", "unknown")
VERDICTS = ("met", "partial", "missing")
KINDS = ("must", "nice")


def as_postings(df: DataFrame) -> DataFrame:
    """Project to the posting columns in order, with missing ones filled."""
    cols = []
    for name in POSTING_COLUMNS:
        kind = "array<string>" if name == "tags" else "string"
        c = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        if name == "tags":
            c = F.coalesce(c, F.array().cast(kind))
        elif name not in ("posted_at", "attribution"):
            c = F.coalesce(c, F.lit("unknown" if name == "workplace" else ""))
        cols.append(c.alias(name))
    return df.select(*cols)


def invalid_rows(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside the allowed set (a quality check, not a filter of results)."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def posted_timestamp(posted_at: Column) -> Column:
    """Feeds mix ISO text with epoch seconds and milliseconds."""
    n = F.when(posted_at.rlike(r"^[0-9]{9,13}$"), posted_at.cast("double"))
    seconds = F.when(n >= 100_000_000_000, n / 1000).otherwise(n)
    return F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(posted_at))
