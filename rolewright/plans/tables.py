"""The driver's tables as candidates, postings, lines and judgments."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import spread_by, spread_small
from ..functions import text as T
from ..functions import vocab as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores when it is small."""
    return spread_small(table(spark, sf_dir, name))


def line_rows(spark: SparkSession, sf_dir: str) -> int:
    """Number of order lines, from the file footers."""
    return table(spark, sf_dir, "lineitem").count()


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as judged requirements: customer = candidate, order = posting, line = requirement, brand (and
    for heavily taxed lines also type) = missing skill. Lines are dealt out by posting, over tasks in proportion to their number."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag")
    rows = line_rows(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    verdict = F.when(F.col("l_quantity") >= 30, "met").when(F.col("l_quantity") >= 15, "partial").otherwise("missing")
    none = F.array().cast("array<string>")
    gaps = F.when(verdict == "met", none).when(F.col("l_tax") > 0.04, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))
    return (
        spread_by(spread_by(li, rows, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")), rows, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("cv_id"),
            F.col("o_orderkey").alias("job_id"),
            F.col("l_linenumber").alias("req_no"),
            F.when(F.col("l_returnflag") == "N", "nice").otherwise("must").alias("kind"),
            verdict.alias("verdict"),
            gaps.alias("missing_skills"),
            F.col("p_brand").alias("skill"),
            F.col("o_totalprice").alias("retrieval_score"),
        )
    )


JUDGMENTS_SQL = """
judged AS (
  SELECT o_custkey AS cv_id, o_orderkey AS job_id, l_linenumber AS req_no,
         CASE WHEN l_returnflag = 'N' THEN 'nice' ELSE 'must' END AS kind,
         CASE WHEN l_quantity >= 30 THEN 'met' WHEN l_quantity >= 15 THEN 'partial' ELSE 'missing' END AS verdict,
         CASE WHEN l_quantity >= 30 THEN 1.0 WHEN l_quantity >= 15 THEN 0.5 ELSE 0.0 END::DOUBLE AS v,
         CASE WHEN l_quantity >= 30 THEN []::VARCHAR[] WHEN l_tax > 0.04 THEN [p_brand, p_type] ELSE [p_brand] END AS missing_skills,
         p_brand AS skill, o_totalprice AS retrieval_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
cover AS (
  SELECT cv_id, job_id, avg(v) FILTER (kind = 'must') AS must_coverage, avg(v) FILTER (kind = 'nice') AS nice_coverage,
         max(retrieval_score) AS retrieval_score
  FROM judged GROUP BY ALL),
sums AS (
  SELECT cv_id, job_id, coalesce(sum((2 * v)::BIGINT) FILTER (kind = 'must'), 0)::BIGINT AS ms, count(*) FILTER (kind = 'must') AS mn,
         coalesce(sum((2 * v)::BIGINT) FILTER (kind = 'nice'), 0)::BIGINT AS ns, count(*) FILTER (kind = 'nice') AS nn FROM judged GROUP BY ALL),
fits AS (
  SELECT *, (2 * CASE WHEN mn > 0 AND nn > 0 THEN 3750 * ms * nn + 1250 * ns * mn ELSE 5000 * (ms + ns) END + greatest(mn, 1) * greatest(nn, 1))
            // (2 * greatest(mn, 1) * greatest(nn, 1)) / 10000.0::DOUBLE AS fit FROM cover JOIN sums USING (cv_id, job_id))
"""


# --- DuckDB counterparts of the text expressions ---------------------------------------------------------------
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(x: str) -> str:
    return f"lower(translate({x}, {lit(T.FOLD_FROM)}, {lit(T.FOLD_TO)}))"


def tokens_sql(x: str) -> str:
    stop = ", ".join(lit(w) for w in T.STOPWORDS)
    return (
        f"list_transform(list_filter(regexp_extract_all({fold_sql(x)}, {lit(T.TOKEN)}), lambda t: t NOT IN ({stop})), "
        "lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)"
    )


def clean_sql(x: str) -> str:
    for a, b in T.LIGATURES.items():
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    keep = [(a, b) for a, b in T.PUNCTUATION.items() if b]
    x = f"translate({x}, {lit(''.join(a for a, _ in keep))}, {lit(''.join(b for _, b in keep))})"
    for a, b in T.PUNCTUATION.items():
        if not b:
            x = f"replace({x}, {lit(a)}, '')"
    x = f"regexp_replace({x}, '[\\x{{E000}}-\\x{{F8FF}}]', '•', 'g')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\t ]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n *', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def html_text_sql(x: str) -> str:
    steps = [
        (r"(?is)<script\b.*?</script>|<style\b.*?</style>", "' '"),
        (r"(?i)<li\b[^>]*>", "chr(10) || '• '"),
        (r"(?i)</li>", "chr(10)"),
        (r"(?i)</?(?:p|div|br|ul|ol|h[1-6]|tr|table|section|article|header|footer)\b[^>]*>", "chr(10)"),
        (r"<[^>]+>", "''"),
    ]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {new}, 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return clean_sql(x)


_BULLET_RUN = r"^(?:[•●▪◦‣∙·○■□◆◇➢➤►▶✓✔☑❖→⁃*–\-]+|\(?[0-9]{1,2}[.)])\s+"
_BULLET_SOLID = r"^[•●▪◦‣∙○■□◆◇➢➤►▶✓✔☑❖]."


def lines_sql(relation: str, key: str, text: str) -> str:
    """SELECT key, line_no, text, is_bullet of the non-blank lines of ``text``."""
    return f"""
      SELECT {key}, line_no, is_bullet, t AS text FROM (
        SELECT {key}, line_no, regexp_matches(s, {lit(_BULLET_RUN)}) OR regexp_matches(s, {lit(_BULLET_SOLID)}) AS is_bullet,
               trim(CASE WHEN regexp_matches(s, {lit(_BULLET_RUN)}) THEN regexp_replace(s, {lit(_BULLET_RUN)}, '')
                         WHEN regexp_matches(s, {lit(_BULLET_SOLID)}) THEN substr(s, 2) ELSE s END) AS t
        FROM (SELECT {key}, generate_subscripts(ls, 1) AS line_no, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS s
              FROM (SELECT {key}, string_split({text}, chr(10)) AS ls FROM {relation}))
        WHERE s <> '')
      WHERE t <> ''"""


# --- Vocabularies drawn from the benchmark table -----------------------------------------------------------------
LONG_TOKEN = 1


def benchmark_aliases(spark: SparkSession, sf_dir: str, min_chars: int = LONG_TOKEN, prefix: int = 4) -> DataFrame:
    """Alias table whose aliases are the runs of letters of the benchmark texts; tokens with a common beginning are
    wordings of one skill. A wording that ends in a vowel is a member, one that ends in ``n`` is weak."""
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("([a-z]+)"), F.lit(1))).alias("alias"))
        .where(F.length("alias") >= min_chars)
        .distinct()
    )
    return V.from_phrases(
        words.select(
            F.upper(F.substring("alias", 1, prefix)).alias("skill"), "alias", F.lit("ci").alias("match"), F.lit("").alias("avoid"),
            F.lit(False).alias("french"), F.col("alias").rlike("[aeiou]$").alias("member"), F.col("alias").rlike("n$").alias("weak"),
        )
    )


def vocabulary_sql(min_chars: int = LONG_TOKEN, prefix: int = 4) -> str:
    return rf"""
vocab AS (
  SELECT DISTINCT a AS alias, upper(left(a, {prefix})) AS skill, regexp_matches(a, '[aeiou]$') AS member, regexp_matches(a, 'n$') AS weak
  FROM (SELECT unnest(regexp_extract_all({fold_sql('text')}, '[a-z]+')) AS a FROM benchmark)
  WHERE length(a) >= {min_chars})"""


def mentions_sql(name: str, relation: str, keys: str, text: str) -> str:
    """CTE ``name``(keys, pos, skill, surface, key, member, weak) of vocabulary words in ``text``."""
    word = r"[\p{L}\p{N}\p{M}_]+[+#]?"
    return rf"""
{name} AS (
  SELECT {keys}, pos, skill, surface, alias AS key, member, weak
  FROM (SELECT {keys}, generate_subscripts(ws, 1)::INTEGER AS pos, unnest(ws) AS w, unnest(raw) AS surface
        FROM (SELECT {keys}, regexp_extract_all({fold_sql(text)}, {lit(word)}) AS ws, regexp_extract_all({text}, {lit(word)}) AS raw FROM {relation}))
  JOIN vocab ON w = alias)"""
