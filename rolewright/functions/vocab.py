"""Vocabulary tables: skills, aliases, implied skills. All are inputs; ``STARTER`` is a small built-in set.

Alias notation (one string per alias, prefixes combine, e.g. ``fr:m:tableaux de bord``)::

    text    any case, accents ignored, spaces and hyphens flexible
    fr:     French wording             m:   a member of the concept, not a synonym
    w:      weak (indirect) evidence   cs:  exact case
    list:   counts only inside a list ("Python, R, C")
    text!x  the alias does not count when the text after it matches the regex x
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut_lineage
from . import text as T

SKILL_SCHEMA = "skill string, kind string, groups array<string>, aliases array<string>, implies array<string>, name_is_alias boolean"
SKILL_KINDS = ("language", "tool", "platform", "concept", "method", "domain", "standard")
PRODUCT_KINDS = ("tool", "platform", "language", "standard")

# A starter vocabulary (name, kind, groups, aliases, implied skills, whether the name is an alias).
# Load the full table of an installation with ``read_skills``.
STARTER = (
    ("Python", "language", ["prog"], ["python3", "fr:langage python"], [], True),
    ("R", "language", ["prog", "stats_lang"], ["rstudio", "r programming", "r language", "list:R"], [], False),
    ("SQL", "language", ["sql"], ["m:t-sql", "m:pl/sql"], [], True),
    ("Java", "language", ["prog", "jvm"], [], [], True),
    ("JavaScript", "language", ["prog"], ["ecmascript", "m:es6", "cs:JS"], [], True),
    ("TypeScript", "language", ["prog"], [], ["JavaScript"], True),
    ("C", "language", ["prog", "systems"], ["c programming", "c language", "fr:langage c", "list:C"], [], False),
    ("C++", "language", ["prog", "systems"], ["cpp"], [], True),
    ("Go", "language", ["prog", "systems"], ["golang", "list:Go!\\s?/\\s?[Nn]o"], [], False),
    ("Rust", "language", ["prog", "systems"], ["rust programming", "rust language", "list:Rust"], [], False),
    ("React", "tool", ["frontend"], ["reactjs", "react.js", "cs:React"], ["JavaScript"], False),
    ("Django", "tool", ["py_web"], [], ["Python"], True),
    ("FastAPI", "tool", ["py_web"], [], ["Python"], True),
    ("REST APIs", "concept", ["api"], ["rest api", "restful", "fr:api rest", "w:web services"], [], True),
    ("Automated testing", "concept", ["testing"], ["test automation", "m:unit testing", "m:unit tests", "cs:TDD", "fr:m:tests unitaires"], [], True),
    ("pytest", "tool", ["testing"], [], ["Python", "Automated testing"], True),
    ("Git", "tool", ["vcs"], ["w:version control"], [], True),
    ("GitHub", "tool", ["vcs"], [], ["Git"], True),
    ("Docker", "tool", ["containers"], ["m:docker compose", "m:containerization"], [], True),
    ("Kubernetes", "tool", ["containers"], ["k8s", "m:helm charts", "cs:Helm"], [], True),
    ("CI/CD", "concept", ["ci"], ["cicd", "m:continuous integration", "fr:m:integration continue"], [], True),
    ("AWS", "platform", ["cloud"], ["cs:AWS", "amazon web services", "m:aws lambda"], [], False),
    ("Azure", "platform", ["cloud"], ["cs:Azure", "microsoft azure"], [], False),
    ("Spark", "tool", ["data_eng", "big_data"], ["apache spark", "m:pyspark", "cs:Spark"], [], False),
    ("Kafka", "tool", ["data_eng", "streaming"], ["apache kafka"], [], True),
    ("PostgreSQL", "tool", ["sql_db"], ["postgres", "m:postgis"], ["SQL"], True),
    ("MySQL", "tool", ["sql_db"], ["m:mariadb"], ["SQL"], True),
    ("pandas", "tool", ["py_data"], [], ["Python"], True),
    ("scikit-learn", "tool", ["ml_lib"], ["sklearn"], ["Machine learning", "Python"], True),
    ("PyTorch", "tool", ["dl_framework"], [], ["Deep learning"], True),
    ("TensorFlow", "tool", ["dl_framework"], [], ["Deep learning"], True),
    ("Machine learning", "concept", ["ml"], ["fr:apprentissage automatique", "cs:ML", "m:random forest"], [], True),
    ("Deep learning", "concept", ["ml", "dl"], ["fr:apprentissage profond", "m:neural networks"], ["Machine learning"], True),
    ("Statistics", "concept", ["stats"], ["statistical analysis", "fr:statistiques", "fr:statistique"], [], True),
    ("Data analysis", "concept", ["analytics"], ["data analytics", "fr:analyse de donnees", "m:data cleaning"], [], True),
    ("Data visualization", "concept", ["viz"], ["dataviz", "fr:visualisation de donnees", "m:plotly", "m:dashboards", "fr:m:tableaux de bord"], [], True),
    ("Power BI", "tool", ["bi", "viz"], ["m:dax"], ["Data visualization"], True),
    ("Tableau", "tool", ["bi", "viz"], ["tableau software", "cs:Tableau! de bord"], ["Data visualization"], False),
    ("Excel", "tool", ["office"], ["cs:Excel", "microsoft excel", "m:pivot tables"], [], False),
    ("Data modeling", "concept", ["data_eng"], ["data modelling", "fr:modelisation de donnees", "fr:modelisation des donnees"], [], True),
    ("Reliability engineering", "domain", ["reliability"], ["fr:ingenierie de la fiabilite", "fr:fiabilite", "m:reliability analysis"], [], True),
    ("FMEA", "method", ["risk_analysis"], ["fmeca", "m:pfmea", "fr:amdec", "failure mode and effects analysis"], ["Reliability engineering"], True),
    ("Fault tree analysis", "method", ["risk_analysis", "sys_rel"], ["fault tree", "cs:FTA", "fr:arbre de defaillance"], ["Reliability engineering"], True),
    ("Weibull analysis", "method", ["life_data"], ["weibull", "fr:loi de weibull"], ["Reliability engineering"], True),
    ("Preventive maintenance", "method", ["maint_strategy"], ["fr:maintenance preventive", "planned maintenance"], [], True),
    ("Predictive maintenance", "method", ["maint_strategy", "pdm"], ["fr:maintenance predictive", "m:prognostics"], [], True),
    ("Condition monitoring", "method", ["cm", "pdm"], ["condition based maintenance", "fr:maintenance conditionnelle"], [], True),
    ("Vibration analysis", "method", ["cm"], ["vibration monitoring", "fr:analyse vibratoire", "w:vibration data"], ["Condition monitoring"], True),
    ("Root cause analysis", "method", ["problem_solving"], ["cs:RCA", "fr:analyse des causes racines", "w:root cause", "m:5 whys"], [], True),
    ("CMMS", "tool", ["cmms"], ["cs:CMMS", "fr:cs:GMAO", "maintenance management system"], [], False),
    ("SAP PM", "tool", ["cmms", "erp"], ["sap plant maintenance"], ["CMMS", "SAP"], True),
    ("SAP", "tool", ["erp"], ["cs:SAP", "m:sap erp"], [], False),
    ("Lean manufacturing", "method", ["lean"], ["lean management", "cs:Lean", "m:kaizen"], [], False),
    ("Project management", "method", ["pm"], ["fr:gestion de projet", "m:cs:PMP"], [], True),
    ("Agile/Scrum", "method", ["pm"], ["cs:Agile", "agile methodology", "m:scrum"], [], False),
    ("Jira", "tool", ["pm"], ["m:confluence"], [], True),
)


def starter_skills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STARTER), SKILL_SCHEMA)


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Full vocabulary as JSON lines or Parquet with the columns of ``SKILL_SCHEMA``."""
    reader = spark.read.schema(SKILL_SCHEMA)
    return reader.parquet(path) if path.rstrip("/").endswith("parquet") else reader.json(path)


def alias_table(skills: DataFrame) -> DataFrame:
    """One row per (skill, alias): match family, key, head word and the pattern that confirms a hit."""
    named = F.when(F.coalesce("name_is_alias", F.lit(True)), F.concat(F.array("skill"), "aliases")).otherwise(F.col("aliases"))
    raw = skills.select("skill", "kind", F.explode(F.array_distinct(named)).alias("raw"))
    prefix = F.regexp_extract("raw", r"^((?:fr:|m:|w:|cs:|list:)*)", 1)
    parts = (
        raw.withColumn("prefix", prefix)
        .withColumn("body", F.expr("substring(raw, length(prefix) + 1)"))
        .withColumn("avoid", F.regexp_extract("body", r"!(.+)$", 1))
        .withColumn("alias", F.trim(F.regexp_replace("body", r"!.+$", "")))
    )
    match = F.when(F.col("prefix").contains("list:"), "list").when(F.col("prefix").contains("cs:"), "cs").otherwise("ci")
    return from_phrases(
        parts.select(
            "skill",
            "kind",
            "alias",
            "avoid",
            match.alias("match"),
            F.col("prefix").contains("fr:").alias("french"),
            F.col("prefix").rlike("m:|w:").alias("member"),
            F.col("prefix").contains("w:").alias("weak"),
        )
    )


def from_phrases(aliases: DataFrame) -> DataFrame:
    """Add ``key``, ``head``, ``lead``, ``pattern`` and ``words`` to (skill, alias, match, avoid, …) rows.

    A flexible space may be absent in the text ("PowerBI"), so an alias is filed under the head word of each
    way to close up its first words.
    """
    phrase = F.when(F.col("match") == "ci", F.regexp_replace(T.fold(F.trim("alias")), r"[\s\-]+", " ")).otherwise(F.col("alias"))
    w = T.WORD_CHAR
    rows = (
        aliases.withColumn("phrase", phrase)
        .withColumn("key", F.when(F.col("match") == "ci", T.alias_key(F.col("alias"))).otherwise(F.col("alias")))
        .withColumn("lead", F.regexp_extract("phrase", rf"^([^{w}]*)", 1))
        .withColumn("rest", F.expr("substring(phrase, length(lead) + 1)"))
        .where("rest <> ''")
    )
    escaped = F.regexp_replace("rest", r"([\\\[\](){}.*+?^$|/&#'])", r"\\$1")
    body = F.when(F.col("match") == "ci", F.regexp_replace(escaped, " ", r"[\\s\\-]*")).otherwise(escaped)
    close = F.when(F.col("match") == "list", "").otherwise(rf"(?![{w}+#])")
    guard = F.when(F.coalesce("avoid", F.lit("")) != "", F.concat(F.lit("(?!"), "avoid", F.lit(")"))).otherwise("")
    # "power bi tool" -> heads power, powerbi, powerbitool
    chunks = F.split("rest", " ")
    closed = F.transform(
        F.sequence(F.lit(1), F.size(chunks)), lambda n: F.array_join(F.slice(chunks, F.lit(1), n), "")
    )
    heads = F.array_distinct(F.transform(closed, lambda s: F.regexp_extract(s, rf"^([{w}]+)", 1)))
    return rows.select(
        "skill",
        *[c for c in ("kind",) if c in aliases.columns],
        "key",
        "match",
        "lead",
        F.concat(F.lit("^"), body, close, guard).alias("pattern"),
        (F.size(F.regexp_extract_all("rest", F.lit(rf"([{w}]+|[^{w}\s])"), F.lit(1)))).alias("words"),
        F.col("french") if "french" in aliases.columns else F.lit(False).alias("french"),
        F.col("member") if "member" in aliases.columns else F.lit(False).alias("member"),
        F.col("weak") if "weak" in aliases.columns else F.lit(False).alias("weak"),
        F.explode(heads).alias("head"),
    ).distinct()


def implication_closure(implies: DataFrame) -> DataFrame:
    """(skill, implied) for every skill that ``implies(skill, implied)`` edges lead to, over chains of any length.

    Each round joins the pairs found so far with themselves, which doubles the length of the chains that are covered, and ends when a round adds nothing.
    Cycles and diamonds add no pair twice.
    """
    known = cut_lineage(implies.select("skill", "implied").where("skill <> implied").distinct())
    n, before = known.count(), -1
    while n != before:
        further = known.select("skill", F.col("implied").alias("via")).join(known.select(F.col("skill").alias("via"), "implied"), "via")
        known = cut_lineage(known.union(further.where("skill <> implied").select("skill", "implied")).distinct())
        n, before = known.count(), n
    return known


def implies_edges(skills: DataFrame) -> DataFrame:
    return skills.select("skill", F.explode("implies").alias("implied"))


def related_pairs(skills: DataFrame) -> DataFrame:
    """(skill, other) that share a group. The input is a vocabulary, not data; pairs stay within groups."""
    g = skills.select("skill", F.explode("groups").alias("grp")).distinct()
    other = g.select(F.col("skill").alias("other"), "grp")
    return g.join(other, "grp").where("skill <> other").select("skill", "other").distinct()


def phrases(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Plain (skill, alias) pairs as an alias table."""
    df = spark.createDataFrame(list(pairs), "skill string, alias string")
    return from_phrases(df.withColumn("match", F.lit("ci")).withColumn("avoid", F.lit("")))
