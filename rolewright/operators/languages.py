"""Human languages with a level from the words around them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Language names (folded) and level wording, strongest first.
LANGUAGES = {
    "English": ["english", "anglais", "englisch", "ingles", "englischkenntnisse"],
    "French": ["french", "francais", "franzosisch", "frances", "franzosischkenntnisse"],
    "Arabic": ["arabic", "arabe", "arabisch"],
    "German": ["german", "allemand", "deutsch", "aleman", "deutschkenntnisse"],
    "Spanish": ["spanish", "espagnol", "espanol", "spanisch"],
    "Italian": ["italian", "italien", "italienisch"],
    "Portuguese": ["portuguese", "portugais"],
    "Dutch": ["dutch", "neerlandais", "niederlandisch"],
    "Turkish": ["turkish", "turc", "turkisch"],
    "Chinese": ["chinese", "mandarin", "chinois"],
    "Japanese": ["japanese", "japonais"],
}
LEVELS = [
    (r"\b(native|mother tongue|langue maternelle|maternelle|natif|native speaker|muttersprache)\b", 5),
    (r"\b(c2|bilingual|bilingue|fluent|fluently|courant|couramment|fliessend|proficient|full professional|sehr gute?)\b", 4),
    (r"\b(c1|advanced|avance|professional working|professionnel)\b", 4),
    (r"\b(b2|upper[- ]intermediate|good command|bonne maitrise|bon niveau|gute)\b", 3),
    (r"\b(b1|intermediate|intermediaire|working knowledge)\b", 2),
    (r"\b(a1|a2|basic|basics|notions|elementary|beginner|debutant|scolaire)\b", 1),
]
DEFAULT_LEVEL = 3
LEVEL_WORDS = {"native": 5, "fluent": 4, "advanced": 4, "intermediate": 3, "basic": 1}


def _level_in(window: Column) -> Column:
    out = F
    for pattern, level in LEVELS:
        out = out.when(window.rlike(pattern), F.lit(level))
    return out


def language_hits(text: Column, languages: dict[str, list[str]] = LANGUAGES) -> Column:
    """Array of struct(lang, level), one per mention in text order. The level comes from the 60 characters after
    the name, then the 40 before it, cut at a separator and at the neighbouring language."""
    folded = T.fold(text)
    names = [a for group in languages.values() for a in group]
    pattern = rf"(?<![{T.WORD_CHAR}])(?:{'|'.join(names)})(?![{T.WORD_CHAR}])"
    split = F.struct(
        F.regexp_extract_all(folded, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(folded, pattern, -1).alias("between")
    )

    def lang(alias: Column) -> Column:
        out = F
        for name, group in languages.items():
            out = out.when(alias.isin(*group), name)
        return out

    def one(alias: Column, i: Column, between: Column) -> Column:
        after = F.substring(F.element_at(F.split(F.get(between, i + 1), r"[\n;|•]"), 1), 1, 60)
        before = F.right(F.element_at(F.split(F.get(between, i), r"[\n;|•]"), -1), F.lit(40))
        return F.struct(
            lang(alias).alias("lang"), F.coalesce(_level_in(after), _level_in(before), F.lit(DEFAULT_LEVEL)).alias("level")
        )

    return T.bind(split, lambda x: F.transform(x["found"], lambda alias, i: one(alias, i, x["between"])))


def language_levels(text: Column, languages: dict[str, list[str]] = LANGUAGES) -> Column:
    """Map of language to its highest level in the text, in order of first mention."""
    hits = language_hits(text, languages)
    return F.aggregate(
        hits,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")),
        lambda acc, h: F.map_concat(
            F.map_filter(acc, lambda k, v: k != h["lang"]),
            F.create_map(h["lang"], F.greatest(h["level"], F.coalesce(F.element_at(acc, h["lang"]), F.lit(0)))),
        ),
    )


def tag_languages(lines: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, lang, level) with the highest level per owner and language."""
    return (
        lines.select(*keys, F.explode(language_hits(F.col(col))).alias("h"))
        .groupBy(*keys, F.col("h.lang").alias("lang"))
        .agg(F.max("h.level").alias("level"))
    )
