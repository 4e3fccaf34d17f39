"""Corpus preparation: normalisation, lines, sentence packing, tokens, language, redaction, HTML lines.

Each job keeps a document in its own row (array expressions, no shuffle) and shuffles only small aggregates.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Hint words per language, in tie order.
LANGUAGE_HINTS = {
    "en": ["the", "and", "with", "you", "will", "for", "our", "experience", "team", "of"],
    "fr": ["le", "la", "les", "et", "des", "avec", "vous", "pour", "une", "nous", "experience", "equipe"],
    "de": ["und", "der", "die", "das", "mit", "sie", "fur", "wir", "ihre", "erfahrung", "du", "dein"],
}

# Personal-data patterns.
_W = r"\p{L}\p{N}\p{M}_"
EMAIL = rf"[{_W}.+-]+@[{_W}-]+(?:\.[{_W}-]+)+"
LINK = r"(?i)(?:https?://|www\.)\S+|(?:linkedin\.com|github\.com|gitlab\.com)/\S+"
PHONE = rf"(?<![{_W}/])\+?\(?[0-9][0-9\s().-]{{6,}}[0-9](?![{_W}/])"
YEAR_RANGE = r"(?:19|20)[0-9]{2}\s*[-–]\s*(?:19|20)[0-9]{2}"
ADDRESS = (
    r"(?i)\b[0-9]{1,4}\s*,?\s*(?:rue|avenue|av\.|street|st\.|road|rd\.|boulevard|bd|blvd|lane|impasse|cité|cite)\b[^\n,;|]*"
)
# What every match of a pattern holds, without word borders and open beginnings: a text is searched for that first.
MAY_HOLD = {EMAIL: "@", LINK: r"(?i)https?://|www\.|(?:linkedin|github|gitlab)\.com/", PHONE: r"[0-9][0-9\s().-]{6,}[0-9]", ADDRESS: r"(?i)[0-9]\s*,?\s*(?:rue|av|st|ro|rd|bo|bd|bl|la|im|cit)"}
HEADER_WORDS = ["curriculum", "vitae", "resume", "cv", "profile", "profil", "summary", "experience", "skills"]


def normalise_corpus(df: DataFrame, col: str) -> DataFrame:
    """Replace ``col`` by its cleaned form and keep whether it changed and how many lines it has."""
    return (
        df.withColumn("__clean", T.clean_text(F.col(col)))
        .withColumn("changed", F.col("__clean") != F.col(col))
        .withColumn(col, F.col("__clean"))
        .withColumn("n_lines", F.size(T.split_lines(F.col(col))))
        .drop("__clean")
    )


def normalise_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    return (
        normalise_corpus(df, col)
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count_if("changed").alias("n_changed"),
            F.sum(F.length(col)).alias("n_chars"),
            F.sum("n_lines").alias("n_lines"),
        )
    )


def to_lines(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, line_no, text, is_bullet) of the non-blank lines; glyphs and numbering are stripped."""
    return (
        df.select(*keys, F.posexplode_outer(T.split_lines(F.col(col))).alias("i", "raw"))
        .where(F.trim("raw") != "")
        .withColumn("b", T.bullet_parts(F.col("raw")))
        .where("b.text <> ''")
        .select(*keys, (F.col("i") + 1).alias("line_no"), F.col("b.text").alias("text"), F.col("b.is_bullet").alias("is_bullet"))
    )


def line_texts(text: Column) -> Column:
    """Array of the texts that ``to_lines`` gives, inside the row."""
    shown = F.transform(F.filter(T.split_lines(text), lambda r: F.trim(r) != ""), lambda r: T.bullet_parts(r)["text"])
    return F.filter(shown, lambda t: t != "")


def pack_sentences(text: Column, limit: int = 420) -> Column:
    """Array of sentence groups of about ``limit`` characters, filled greedily."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) > limit)
        return F.when(
            full, F.struct(F.concat(acc["done"], F.array(F.trim(acc["cur"]))).alias("done"), F.concat(F.lit(" "), s).alias("cur"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(" "), s).alias("cur")))

    packed = F.aggregate(
        T.split_sentences(text),
        empty,
        add,
        lambda acc: F.when(F.trim(acc["cur"]) != "", F.concat(acc["done"], F.array(F.trim(acc["cur"])))).otherwise(acc["done"]),
    )
    whole = T.bind(packed, lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)


def token_table(df: DataFrame, keys: Sequence[str], col: str, stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """(keys, pos, token) content tokens in order."""
    rows = df.select(*keys, F.posexplode_outer(T.tokens(F.col(col), stopwords)).alias("pos", "token"))
    return rows.where("token is not null")


# --- Language ----------------------------------------------------------------------------------------------
def language_of(text: Column, hints: dict[str, list[str]] = LANGUAGE_HINTS, head_chars: int | None = None) -> Column:
    """Language with the most hint words; ties go to the first in ``hints``. ``head_chars`` limits the text read."""
    body = F.substring(text, 1, head_chars) if head_chars else text
    words = F.regexp_extract_all(T.fold(body), F.lit("([a-z]+)"), F.lit(1))
    counts = F.aggregate(
        words,
        F.array(*[F.lit(0) for _ in hints]),
        lambda acc, w: F.array(*[acc[i] + w.isin(*ws).cast("int") for i, ws in enumerate(hints.values())]),
    )
    names = F.array(*[F.lit(x) for x in hints])
    return F.element_at(names, F.array_position(counts, F.array_max(counts)).cast("int"))


def detect_language(df: DataFrame, col: str, head_chars: int | None = None) -> DataFrame:
    return df.withColumn("predicted", language_of(F.col(col), head_chars=head_chars))


def language_confusion(df: DataFrame, col: str, known: str) -> DataFrame:
    return detect_language(df, col).groupBy(known, "predicted").agg(F.count(F.lit(1)).alias("n_docs"))


# --- Redaction ---------------------------------------------------------------------------------------------
def _is_phone(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return digits.between(8, 15) & ~c.rlike(YEAR_RANGE)


def _mask(text: Column, pattern: str, mark: str, when) -> tuple[Column, Column]:
    """Replace the matches of ``pattern`` that satisfy ``when``; returns (text, number replaced)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = F.split(text, pattern, -1)
    masked = F.transform(found, lambda m: F.when(when(m), F.lit(mark)).otherwise(m))
    joined = F.array_join(F.zip_with(parts, masked, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    may = _may_hold(text, pattern)
    return F.when(may & (F.size(found) > 0), joined).otherwise(text), F.when(may, F.size(F.filter(found, when))).otherwise(_none(text))


def _may_hold(text: Column, pattern: str) -> Column:
    """False for texts that surely hold no match."""
    part = MAY_HOLD[pattern]
    return text.contains(part) if part == "@" else text.rlike(part)


def _none(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lit(0))


def _all_matches(text: Column, pattern: str) -> Column:
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return F.when(_may_hold(text, pattern), F.size(F.regexp_extract_all(text, F.lit(f"{flag}({body})"), F.lit(1)))).otherwise(_none(text))


def _replaced(text: Column, pattern: str, mark: str) -> Column:
    return F.when(_may_hold(text, pattern), F.regexp_replace(text, pattern, mark)).otherwise(text)


def looks_like_name(line: Column) -> Column:
    """Two to four capitalised words without digits, marks or header words."""
    words = F.split(line, r"\s+", 5)
    return (
        F.size(words).between(2, 4)
        & ~line.rlike(r"[0-9@\[\]|:,]")
        & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | ~w.rlike(r"^\p{L}"))
        & ~F.exists(words, lambda w: T.fold(w).isin(*HEADER_WORDS))
    )


def _heads(text: Column) -> Column:
    """The first three lines of a text without those too long for a name: seven parts are five words at least, whatever stands around them."""
    return F.transform(F.filter(F.slice(F.split(text, "\n", 4), 1, 3), lambda s: F.size(F.split(s, r"\s+", 7)) < 7), T.strip)


def redact(df: DataFrame, col: str, skill_lines: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mask e-mail, links, phone numbers, street addresses and the name, in that order, and count each kind.

    ``skill_lines`` (keys, line) lists lines known to name a skill; they are never taken for a name. The name
    is the first fitting line among the first three and is masked wherever it occurs, but counts once.
    """
    x = F.col(col)
    out = df.withColumn("n_email", _all_matches(x, EMAIL)).withColumn(col, _replaced(x, EMAIL, "[email]"))
    out = out.withColumn("n_link", _all_matches(x, LINK)).withColumn(col, _replaced(x, LINK, "[link]"))
    text, n = _mask(x, PHONE, "[phone]", _is_phone)
    out = out.withColumn("n_phone", n).withColumn(col, text)
    out = out.withColumn("n_address", _all_matches(x, ADDRESS)).withColumn(col, _replaced(x, ADDRESS, "[address]"))
    heads = _heads(x)
    if skill_lines is not None:
        per_doc = skill_lines.groupBy(*keys).agg(F.collect_set("line").alias("__skill_lines"))
        out = out.join(per_doc, list(keys), "left")
        named = F.filter(heads, lambda s: looks_like_name(s) & ~F.coalesce(F.array_contains("__skill_lines", s), F.lit(False)))
    else:
        named = F.filter(heads, looks_like_name)
    out = out.withColumn("__name", F.get(named, F.lit(0)))
    return (
        out.withColumn("n_name", F.col("__name").isNotNull().cast("int"))
        .withColumn(col, F.when(F.col("__name").isNotNull(), F.replace(x, F.col("__name"), F.lit("[name]"))).otherwise(x))
        .drop("__name", "__skill_lines")
    )


def name_candidates(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, line) the header lines that could be a name; tag them to build ``skill_lines``."""
    heads = F.filter(_heads(F.col(col)), looks_like_name)
    return df.select(*keys, F.explode(heads).alias("line"))


REDACTION_KINDS = ("email", "link", "phone", "address", "name")


def redaction_counts(df: DataFrame, col: str, by: str) -> DataFrame:
    return (
        redact(df.select(by, col), col)
        .groupBy(by)
        .agg(*[F.sum(f"n_{k}").cast("long").alias(f"n_{k}") for k in REDACTION_KINDS])
    )


# --- HTML --------------------------------------------------------------------------------------------------
def html_to_lines(pages: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, line_no, text, is_bullet) of HTML pages."""
    text = pages.select(*keys, T.html_to_text(F.col(col)).alias("__text"))
    return to_lines(text, keys, "__text")


def html_stats(pages: DataFrame, key: str, col: str) -> DataFrame:
    lines = T.split_lines(T.html_to_text(F.col(col)))
    full = F.filter(lines, lambda s: s != "")
    return pages.select(key, full.alias("lines")).select(
        key,
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda s: s.startswith("•"))).alias("n_bullets"),
        F.aggregate("lines", F.lit(0), lambda a, s: a + F.length(s)).alias("n_chars"),
    )
