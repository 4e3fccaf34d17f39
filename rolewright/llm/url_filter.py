"""URL filters: logistic regression on hashed character n-grams of host and path, with rules that take precedence.

The model learns from a small labelled URL table with Spark's DataFrame machine learning and is applied as column
expressions: no Python runs on the executors.
"""
from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
SIZES = (3, 4)
LABELLED_BOUND = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Invented examples: 1 is to be blocked.
LABELLED = (
    ("https://cheap-pills.test/buy/now", 1), ("http://www.cheap-pills.test/en/12", 1), ("https://m.best-pills.test/offer", 1), ("http://pills-online.test/order.html", 1),
    ("https://spam-farm.test/en/4", 1), ("http://blog.spam-farm.test/de/871", 1), ("https://link-farm.test/list?page=3", 1), ("http://www.link-farm.test/fr/55", 1),
    ("https://casino-bonus.test/spin", 1), ("http://free-casino.test/en/777.html", 1), ("https://www.online-casino.test/slots/", 1), ("http://poker-win.test/bonus", 1),
    ("https://adult-cams.test/live", 1), ("http://xxx-videos.test/en/9", 1), ("https://www.hot-xxx.test/watch", 1), ("http://payday-loans.test/apply", 1),
    ("https://quick-loans.test/cash/now", 1), ("http://free-iphone-win.test/claim", 1), ("https://clickbait-ads.test/en/31", 1), ("http://ads-tracker.test/banner/88", 1),
    ("https://replica-watches.test/shop", 1), ("http://keygen-crack.test/download.exe", 1), ("https://torrent-warez.test/get/12", 1), ("http://seo-links.test/buy-links", 1),
    ("https://free-bets.test/odds", 1), ("http://www.sports-bets.test/en/6", 1), ("https://m.ads-track.test/pixel", 1), ("http://m.cheap-loans.test/de/7", 1),
    ("https://lottery-prize.test/winner", 1), ("http://malware-site.test/en/5", 1), ("https://phishing-login.test/verify/account", 1), ("http://scam-offers.test/es/40", 1),
    ("https://notes.test/en/25", 0), ("http://www.library.test/de/871", 0), ("https://blog.gardens.test/en/853/", 0), ("http://m.history.test/fr/44.html", 0),
    ("https://news.harbour.test/es/777", 0), ("https://docs.kernel.test/guide/intro.html", 0), ("http://museum.test/en/12", 0), ("https://www.school.test/fr/55", 0),
    ("https://blog.ththan.test/en/960", 0), ("http://therha.test/en/676", 0), ("https://ththin.test/en/31", 0), ("http://thering.test/de/40", 0),
    ("https://www.recipes.test/en/9", 0), ("http://weather.test/fr/825", 0), ("https://research.test/papers/2031.pdf", 0), ("http://blog.tionsh.test/es/533/", 0),
    ("https://travel.test/en/5", 0), ("http://wiki.test/de/Haus", 0), ("https://m.therou.test/en/474.html", 0), ("http://university.test/course/12", 0),
    ("https://music.test/list", 0), ("http://www.trains.test/es/40", 0), ("https://council.test/en/4", 0), ("http://forum.test/thread/88", 0),
    ("https://m.ththth.test/en/25", 0), ("http://www.ththre.test/fr/825", 0), ("https://tiontion.test/en/853", 0), ("http://m.museum.test/de/3", 0), ("https://www.parks.test/", 0), ("http://m.news.test", 0),
    ("https://maths.test/en/777.html", 0), ("http://bookshop.test/shop", 0), ("https://theatre.test/watch", 0), ("http://blog.theres.test/fr/176/", 0),
)


@dataclass(frozen=True)
class Rule:
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


PRODUCTION_RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path then up to ``?``, ``#`` or the end.
    Both are empty for null and where there is no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked at both ends."""

    def cut(text: Column, part: str) -> list[Column]:
        # the lambda binds the characters: they are split once, not once for each n-gram
        chars = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
        none = F.array().cast("array<int>")

        def bucket(c: Column, i: Column, n: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(part), F.array_join(F.slice(c, i, n), "")), F.lit(BUCKETS)).cast("int")

        def hashed(c: Column, n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
            return F.when(F.size(c) >= n, F.transform(starts, lambda i: bucket(c, i, n))).otherwise(none)

        def of(n: int) -> Column:
            return F.flatten(F.transform(chars, lambda c: hashed(c, n)))

        return [of(n) for n in SIZES]

    return F.array_distinct(F.flatten(F.array(*cut(host, "h"), *cut(path, "p"))))


def labelled_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float


def train(labelled: DataFrame, ridge: float = 0.0002, blocked_share: float = 0.2) -> Model:
    """Logistic regression on ``labelled(url, label)``, a small table of at most LABELLED_BOUND rows; null urls or labels are left out.
    The table holds about as many of both labels; the bias is the log odds of ``blocked_share``, the share expected among all urls, so a url
    of which the model knows nothing is allowed.
    Without rows of both labels the model allows everything."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    if n > LABELLED_BOUND:
        raise ValueError(f"the labelled table has {n} rows; the bound is {LABELLED_BOUND}")
    if blocked in (0, n):
        return Model((0.0,) * BUCKETS, -1.0)
    host, path = host_and_path(F.col("url"))
    hit = grams(host, path)
    x = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.array_contains("hit", b).cast("double") / F.sqrt(F.size("hit")))
    rows = rows.select(hit.alias("hit"), (F.col("label") > 0).cast("double").alias("label")).coalesce(1)
    fitted = LogisticRegression(regParam=ridge, standardization=False, fitIntercept=False, maxIter=100).fit(rows.select(array_to_vector(x).alias("features"), "label"))
    return Model(tuple(float(w) for w in fitted.coefficients.toArray()), math.log(blocked_share / (1 - blocked_share)))


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = (), threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row: one scan of id and url, no shuffle.

    Of the rules that fit (their host or a subdomain of it, a path that starts with theirs) the longest decides; ties go to the rule
    given first. Without one the model blocks at ``threshold``. Null urls and urls without ``://`` have empty host and path and are judged by
    the model. ``rules`` are a short list written by hand; they are part of the plan. Repeated rows give repeated rows; other
    columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    hit = grams(F.col("host"), F.col("path"))
    scored = base.withColumn("hit", hit)
    total = F.aggregate("hit", F.lit(0.0), lambda a, b: a + F.element_at(weights, b + 1))
    score = 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("hit"), F.lit(1))) + F.lit(model.bias))))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path), reverse=True)[::-1]:
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("score", score).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
