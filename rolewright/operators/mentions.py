"""Skill mentions: dictionary join over word windows, never one regex with thousands of branches."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checked_broadcast, explode_once
from ..functions import text as T

_WORD = f"([{T.WORD_CHAR}]+)"
_LIST_LEFT = r"(?:[,/|;(] ?|and |et )$"


def word_windows(text: Column, words: int) -> Column:
    """Array of struct(pos, left, span): each word with a little left context and the text of up to ``words``
    words and symbols from it on. Built inside the row, so the text is neither shuffled nor repeated."""
    def pieces(x: Column) -> Column:
        after = F.slice(x["gaps"], 2, 1_000_000_000)
        return F.struct(x["ws"].alias("ws"), F.element_at(x["gaps"], 1).alias("first"), F.zip_with(x["ws"], after, lambda w, g: F.concat(w, g)).alias("ps"))

    def windows(x: Column) -> Column:
        return F.transform(
            x["ws"],
            lambda w, i: F.struct(
                (i + 1).cast("int").alias("pos"),
                F.right(F.when(i == 0, x["first"]).otherwise(F.get(x["ps"], i - 1)), F.lit(8)).alias("left"),
                w.alias("word"),
                # Indexed reads: a slice would copy the whole array once per word.
                F.concat_ws("", *[F.get(x["ps"], i + k) for k in range(words)]).alias("span"),
            ),
        )

    split = F.struct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)).alias("ws"), F.split(text, _WORD, -1).alias("gaps"))
    return T.bind(split, lambda x: T.bind(pieces(x), windows))


def tag_mentions(lines: DataFrame, keys: Sequence[str], text: str, aliases: DataFrame) -> DataFrame:
    """Every skill mention of every line: keys, pos, skill, surface, key, french, member, weak.

    Words are joined to the alias heads, the pattern of the alias confirms the hit on the word window, then
    per line the longest hit at a place wins and hits do not overlap within the any-case and the exact-case
    family. Only confirmed hits are shuffled. ``pos`` is the 1-based word position of the hit.
    """
    return resolve_hits(find_candidates(lines, keys, text, aliases), keys).select(
        *keys, "pos", "skill", "surface", T.alias_key(F.col("surface")).alias("key"), "french", "member", "weak"
    )


def find_candidates(lines: DataFrame, keys: Sequence[str], text: str, aliases: DataFrame) -> DataFrame:
    span = aliases.agg(F.max("words")).first()[0] or 1
    heads = aliases.select(T.fold(F.col("head")).alias("head"), "skill", "match", "lead", "pattern", "french", "member", "weak")
    words = lines.select(*keys, explode_once(word_windows(F.col(text), int(span) + 2)).alias("w")).select(
        *keys, "w.pos", "w.left", "w.span", T.fold(F.col("w.word")).alias("folded")
    )
    joined = words.join(checked_broadcast(heads), F.col("folded") == F.col("head"))
    w = T.WORD_CHAR
    shown = F.when(F.col("match") == "ci", T.fold(F.col("span"))).otherwise(F.col("span"))
    hits = (
        joined.withColumn("hit", F.call_function("regexp_extract", shown, F.col("pattern"), F.lit(0)))
        .where("hit <> ''")
        .withColumn("after", F.expr("substring(span, length(hit) + 1)"))
    )
    led = (F.col("lead") == "") | F.expr("endswith(left, lead)")
    before = F.expr("substring(left, 1, length(left) - length(lead))")
    plain = led & ((F.col("lead") == "") | ~before.rlike(f"[{w}]$"))
    listed = (F.col("left").rlike(_LIST_LEFT) & ~F.col("after").rlike(rf"^[{w}&'.+#-]")) | (
        ~F.col("left").rlike(rf"[{w}&.'/-]$") & F.col("after").rlike(r"^\s?[,/|;)]")
    )
    ok = F.when(F.col("match") == "list", listed).otherwise(plain)
    surface = F.concat("lead", F.expr("substring(span, 1, length(hit))"))
    n_words = F.size(F.regexp_extract_all("hit", F.lit(_WORD), F.lit(1)))
    return hits.where(ok).select(
        *keys, "pos", (F.col("pos") + n_words).alias("stop"), "match", "skill", surface.alias("surface"), "french", "member", "weak",
        F.length("hit").alias("chars"),
    )


_HIT = "match:string,pos:int,neg:int,skill:string,surface:string,stop:int,french:boolean,member:boolean,weak:boolean"


def resolve_hits(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leftmost, longest, non-overlapping per line and family; then one hit per (line, skill, pos).

    One shuffle by line. The collected list holds the hits of ONE line, that is of one input value, so its size is
    bounded by that value.
    """
    hit = F.struct("match", "pos", (-F.col("chars")).alias("neg"), "skill", "surface", "stop", "french", "member", "weak")
    lines = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    start = F.struct(
        F.lit("").alias("match"), F.lit(0).alias("free"), F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.array().cast(f"array<struct<{_HIT}>>").alias("out")
    )

    def step(acc: Column, h: Column) -> Column:
        free = F.when(acc["match"] == h["match"], acc["free"]).otherwise(0)
        twin = (acc["match"] == h["match"]) & (acc["pos"] == h["pos"]) & (acc["neg"] == h["neg"])
        out = F.concat(acc["out"], F.array(h)).alias("out")
        return (
            F.when((h["match"] == "list") | twin, F.struct(acc["match"].alias("match"), acc["free"].alias("free"), acc["pos"].alias("pos"), acc["neg"].alias("neg"), out))
            .when(h["pos"] >= free, F.struct(h["match"].alias("match"), h["stop"].alias("free"), h["pos"].alias("pos"), h["neg"].alias("neg"), out))
            .otherwise(acc)
        )

    def once(out: Column) -> Column:
        by_skill = F.sort_array(F.transform(out, lambda h: F.struct(h["skill"].alias("skill"), h["pos"].alias("pos"), h["neg"].alias("neg"), h.alias("h"))))
        return T.bind(
            by_skill,
            lambda xs: F.filter(
                xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["skill"] != x["skill"]) | (F.get(xs, i - 1)["pos"] != x["pos"])
            ),
        )

    def reaches(p: Column, h: Column) -> Column:
        twin = (p["pos"] == h["pos"]) & (p["neg"] == h["neg"])
        return (p["match"] == h["match"]) & (h["match"] != "list") & (h["pos"] < p["stop"]) & ~twin

    # the fold copies what it has kept with every hit, which is quadratic in a long line; without hits that reach into the next one it keeps all
    crossed = F.exists(F.transform("hits", lambda h, i: (i > 0) & reaches(F.get("hits", i - 1), h)), lambda c: c)
    kept = once(F.when(crossed, F.aggregate("hits", start, step, lambda acc: acc["out"])).otherwise(F.col("hits")))
    return lines.select(*keys, explode_once(kept).alias("x")).select(*keys, "x.h.*")


def canonicalise(terms: DataFrame, term: str, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct terms with their ``skill``: exact name, else the first mention that covers at least 60% of the
    term, else a name with the same folding, else null."""
    t = terms.select(F.trim(term).alias("term")).where("term <> ''").distinct()
    exact = skills.select(F.col("skill").alias("exact"), F.col("skill").alias("term"))
    covering = (
        tag_mentions(t, ["term"], "term", aliases)
        .where(F.length("surface") >= 0.6 * F.length("term"))
        .groupBy("term")
        .agg(F.min_by("skill", F.struct("pos", -F.length("surface"), "skill")).alias("covering"))
    )
    same_fold = skills.groupBy(T.fold(F.col("skill")).alias("folded")).agg(F.min("skill").alias("same_fold"))
    return (
        t.join(checked_broadcast(exact), "term", "left")
        .join(covering, "term", "left")
        .withColumn("folded", T.fold(F.col("term")))
        .join(checked_broadcast(same_fold), "folded", "left")
        .select("term", F.coalesce("exact", "covering", "same_fold").alias("skill"))
    )


def implied_skills(owned: DataFrame, owner: str, closure: DataFrame) -> DataFrame:
    """(owner, skill, implied_by): the owned skills with a null label, plus those they imply. When several
    owned skills imply one, the label is the smallest name."""
    have = owned.select(owner, "skill").distinct()
    reached = (
        have.withColumnRenamed("skill", "source")
        .join(checked_broadcast(closure), F.col("source") == closure["skill"])
        .select(owner, F.col("implied").alias("skill"), "source")
    )
    return (
        have.withColumn("source", F.lit(None).cast("string"))
        .withColumn("own", F.lit(1))
        .unionByName(reached.withColumn("own", F.lit(0)))
        .groupBy(owner, "skill")
        .agg(F.max("own").alias("own"), F.min("source").alias("source"))
        .select(owner, "skill", F.when(F.col("own") == 0, F.col("source")).alias("implied_by"))
    )
