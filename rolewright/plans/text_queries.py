"""Text, vocabulary, retrieval and evaluation operators over documents, pages, conversations and benchmark."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import evaluate as E
from ..operators import judge as J
from ..operators import lines as N
from ..operators import mentions as M
from ..operators import postings as P
from ..operators import retrieval as R
from ..operators import tailor as L
from ..operators import triage as G
from ..cluster import checked_broadcast, cut_lineage, spread_small, stage_table
from .tables import (
    benchmark_aliases, clean_sql, fold_sql, html_text_sql, lines_sql, lit, mentions_sql, table, texts, tokens_sql, vocabulary_sql,
)

#: So many ids are sent to every task rather than texts to their ids.
NUMBERS = 4_000_000

# --- Corpus preparation -------------------------------------------------------------------------------------------
def corpus_normalise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalise_stats(texts(spark, sf_dir, "documents"), "text", "source")


def html_to_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.html_stats(texts(spark, sf_dir, "pages"), "page_id", "html")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.html_to_lines(texts(spark, sf_dir, "pages"), ["page_id"], "html")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.to_lines(texts(spark, sf_dir, "documents"), ["doc_id"], "text")


def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = N.pack_sentences(F.regexp_replace("text", r"\s+", " "))
    d = texts(spark, sf_dir, "documents").select("doc_id", packed.alias("p"))
    return d.select("doc_id", F.size("p").alias("n_packs"), F.array_max(F.transform("p", lambda s: F.length(s))).alias("longest"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = N.token_table(texts(spark, sf_dir, "documents"), ["lang"], "text")
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.language_confusion(texts(spark, sf_dir, "documents"), "text", "lang")


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.redaction_counts(texts(spark, sf_dir, "documents"), "text", "source")


# --- Vocabulary joins ----------------------------------------------------------------------------------------------
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.tag_mentions(texts(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", cut_lineage(benchmark_aliases(spark, sf_dir)))
    return m.groupBy("skill").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"), F.count_if("member").alias("n_member"), F.count_if("weak").alias("n_weak")
    )


def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two words: the first two words of each benchmark text, with flexible spaces and hyphens."""
    two = F.regexp_extract(T.fold(F.col("text")), r"^([a-z]+ [a-z]+)", 1)
    b = table(spark, sf_dir, "benchmark").select(two.alias("skill")).where("skill <> ''").distinct()
    aliases = V.from_phrases(b.select("skill", F.col("skill").alias("alias"), F.lit("ci").alias("match"), F.lit("").alias("avoid")))
    m = M.tag_mentions(texts(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", cut_lineage(aliases))
    return m.groupBy("skill").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_mentions"))


def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as terms; the nouns are the skills."""
    p = table(spark, sf_dir, "part").select("p_name")
    skills = p.select(F.initcap(F.split("p_name", " ")[1]).alias("skill")).distinct()
    aliases = V.from_phrases(skills.select("skill", F.col("skill").alias("alias"), F.lit("ci").alias("match"), F.lit("").alias("avoid")))
    terms = p.unionByName(p.select(F.upper(F.split("p_name", " ")[1]).alias("p_name")))
    return M.canonicalise(terms, "p_name", skills, cut_lineage(aliases))


def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each conversation shows each skill: turns are lines, roles are sections."""
    c = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "user", "experience").when(F.col("role") == "assistant", "skills").otherwise("other")
    units = c.select(
        F.col("conv_id").alias("cv_id"), F.col("turn").alias("unit_no"), F.concat(F.lit("E"), F.col("turn").cast("string")).alias("unit_id"), section.alias("section"), "text"
    )
    m = cut_lineage(M.tag_mentions(units, ["cv_id", "unit_no"], "text", cut_lineage(benchmark_aliases(spark, sf_dir))))
    idx = J.skill_index(m, units)
    return idx.select("cv_id", "skill", F.array_join("ids", ",").alias("ids"), F.array_join("keys", ",").alias("keys"), "weak_only", "plain")


def term_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording of conversations against the document with the same number."""
    aliases = cut_lineage(benchmark_aliases(spark, sf_dir))
    c = texts(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cv_id"), F.col("turn").alias("unit_no"), "text")
    pairs = c.select("cv_id", F.col("cv_id").alias("job_id")).distinct()
    # a document of no pair has no part in the join, so its text is not searched
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text")
    d = spread_small(d.join(checked_broadcast(cut_lineage(pairs.select("job_id")), NUMBERS), "job_id", "left_semi"))
    pm = M.tag_mentions(d, ["job_id"], "text", aliases).select("job_id", F.col("pos").alias("at"), "skill", "surface", "key", "member")
    terms = L.posting_terms(pm.limit(0), pm)
    um = M.tag_mentions(c, ["cv_id", "unit_no"], "text", aliases)
    return L.alignments(um, terms, pairs).select("cv_id", "job_id", "unit_no", "skill", "cv_term", "jd_term")


# --- Triage ----------------------------------------------------------------------------------------------------------
def _token_skills(df: DataFrame, owner: str, col: str) -> DataFrame:
    return df.select(owner, F.array_distinct(T.tokens(F.col(col))).alias("skills"))


def _most(n):
    """Three tokens at least, and four of ten."""
    return F.greatest(F.lit(3), ((n * 4 + 9) / 10).cast("int"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cv_id"), "text")
    return G.shared_skills(cut_lineage(_token_skills(b, "cv_id", "text")), _token_skills(d, "job_id", "text"), _most)


def skill_overlap_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(spark, sf_dir).select("cv_id", "job_id", "n_overlap")


def _part_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as titles. Each type asks for one whole name with its words turned round, and for one noun alone."""
    p = table(spark, sf_dir, "part")
    titles = p.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"))
    q = p.groupBy(F.col("p_type").alias("cv_id")).agg(F.min("p_name").alias("a"), F.max(F.split("p_name", " ")[1]).alias("b"), F.min(F.split("p_name", " ")[1]).alias("c"))
    turned = F.concat_ws(" of ", F.split("a", " ")[1], F.split("a", " ")[0])
    noun = F.when(F.length("cv_id") % 2 == 0, F.col("b")).otherwise(F.col("c"))
    return q.select("cv_id", F.posexplode(F.array(turned, noun)).alias("pos", "query")), titles


def _part_triage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types and brands as candidates (brands ask for nothing), part names as postings, the matches."""
    queries, titles = _part_queries(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    cvs = p.select(F.col("p_type").alias("cv_id")).union(p.select("p_brand")).distinct()
    return cvs, titles, cut_lineage(G.first_title_match(queries, titles))


def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs, titles, triaged = _part_triage(spark, sf_dir)
    return G.triage_summary(cvs, triaged, titles.agg(F.count(F.lit(1))).scalar())


def rejected_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs, titles, triaged = _part_triage(spark, sf_dir)
    pool = titles.withColumn("first_seq", F.col("job_id") * 3 % 1009)
    return G.rejected_titles(cvs, triaged, pool, 40, ("first_seq", "job_id"))


def title_match_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, titles = _part_queries(spark, sf_dir)
    return G.first_title_match(queries, titles)


def widen_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    _, titles = _part_queries(spark, sf_dir)
    plans = p.groupBy(F.col("p_type").alias("cv_id")).agg(F.array_sort(F.collect_set("p_name")).alias("titles"), F.count(F.lit(1)).alias("n"))
    plans = cut_lineage(plans.select("cv_id", F.slice("titles", 2, 1).alias("queries"), "titles"))
    out = G.widen_search(plans, titles, min_relevant=250)
    return out.select("cv_id", "round", "n_relevant", F.col("target").cast("long").alias("target"), F.array_join("queries", ";").alias("queries"))


# --- Retrieval -------------------------------------------------------------------------------------------------------
def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), T.tokens(F.col("text")).alias("tokens"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cv_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.bm25(_docs(spark, sf_dir), R.query_terms(_items(spark, sf_dir))).withColumn("score", F.round("bm25", 5))
    return R.rank_by(scores, "score", 5).select(F.col("cv_id").alias("item_id"), F.col("job_id").alias("doc_id"), "score", "rank")


def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("cv_id", T.tokens(F.col("text")).alias("tokens"))
    scores = R.tfidf_cosine(_docs(spark, sf_dir), items).withColumn("score", F.round("cosine", 6))
    return R.rank_by(scores, "score", 5).select(F.col("cv_id").alias("item_id"), F.col("job_id").alias("doc_id"), "score", "rank")


def hybrid_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage by shared words, then BM25 and line matching inside the triaged pairs, fused by rank."""
    pairs = cut_lineage(overlap_pairs(spark, sf_dir).select("cv_id", "job_id"))
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    wanted = pairs.select("job_id").distinct()
    lines = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text").join(checked_broadcast(wanted, NUMBERS), "job_id", "left_semi")
    lines = N.to_lines(lines, ["job_id"], "text")
    chunks = stage_table(lines.select("job_id", F.col("line_no").alias("chunk_no"), T.tokens(F.col("text")).alias("terms")))
    clauses = items.select("cv_id", F.posexplode(F.split("text", "[.,]")).alias("unit_no", "clause"))
    units = clauses.where("trim(clause) <> ''").select("cv_id", "unit_no", T.tokens(F.col("clause")).alias("terms"))
    cosines = R.line_cosines(pairs, chunks, units, "pair")
    semantic = R.maxsim(pairs, chunks, cosines).withColumn("semantic", F.round("semantic", 5))
    keyword = R.bm25_in_pool(docs, R.query_terms(items), pairs).withColumn("bm25", F.round("bm25", 5))
    fused = R.rrf(keyword.join(semantic, ["cv_id", "job_id"])).withColumn("rrf", F.round("rrf", 9))
    return R.shortlist(fused).select("cv_id", "job_id", "bm25", "semantic", F.round("rrf", 6).alias("rrf"), "place")


def dense_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors in blocks of sixteen: block n holds the lines of candidate n and the chunks of posting n; each
    candidate is paired with the next posting."""
    e = table(spark, sf_dir, "embeddings")
    block = F.floor(F.col("vec_id") / 16).cast("long")
    units = e.select(block.alias("cv_id"), F.col("vec_id").alias("unit_no"), F.col("embedding").alias("vec"))
    chunks = e.select(block.alias("job_id"), F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vec"))
    pairs = units.select("cv_id").distinct().select("cv_id", (F.col("cv_id") + 1).alias("job_id"))
    held = chunks.select("job_id").distinct()
    pairs = pairs.join(held, "job_id", "left_semi").select("cv_id", "job_id")
    out = R.maxsim(pairs, chunks, R.dense_cosines(pairs, chunks, units))
    return out.select("cv_id", "job_id", F.round("semantic", 5).alias("semantic"))


# --- Evaluation ------------------------------------------------------------------------------------------------------
def _methods(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    d = texts(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("distinct_tokens"))
    base = cut_lineage(d.select(F.col("source").alias("cv_id"), F.col("doc_id").alias("job_id"), "n_chars", "distinct_tokens"))
    methods = {
        "by_length": base.select("cv_id", "job_id", F.col("n_chars").cast("double").alias("score")),
        "by_variety": base.select("cv_id", "job_id", F.col("distinct_tokens").cast("double").alias("score")),
        "by_id": base.select("cv_id", "job_id", (-F.col("job_id")).cast("double").alias("score")),
    }
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), (F.col("quality") * 2 - F.col("toxic")).alias("rel"))
    labels = labels.withColumn("rel", F.greatest("rel", F.lit(0))).join(base.select("cv_id", "job_id"), "job_id")
    return methods, labels


def ndcg_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods, labels = _methods(spark, sf_dir)
    return E.ndcg(methods["by_length"], labels, 5).select(F.col("cv_id").alias("source"), F.round("ndcg", 6).alias("ndcg"))


def compare_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods, labels = _methods(spark, sf_dir)
    return E.compare_rankings(methods, labels, 5).select("method", F.round("ndcg", 6).alias("ndcg"), "n_cvs")


# --- Requirements and drafts -----------------------------------------------------------------------------------------
def requirement_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = N.to_lines(texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text"), ["job_id"], "text")
    kinds = lines.select("job_id", "line_no", F.when(F.length("text") % 3 == 0, "nice").otherwise("must").alias("kind"), "text")
    kept = P.prioritise(P.dedupe_lines(kinds, P.WORDING_CHARS).withColumn("line", F.col("line_no")), P.MUST_LIMIT, P.REQUIREMENT_LIMIT)
    return kept.select("job_id", "req_no", "kind", "line")


def _turn_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    return a.join(b, ["conv_id", "turn"])


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = cut_lineage(benchmark_aliases(spark, sf_dir))
    closure = spark.createDataFrame([], "skill string, implied string")
    return L.draft_problems(_turn_drafts(spark, sf_dir), ["conv_id", "turn"], aliases, closure)


def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("conv_id", "turn", F.array_join("problems", " | ").alias("problems"))


def fabrication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First draft: the next turn. Second draft: the original itself, which always passes."""
    keys = ["conv_id", "turn"]
    first = cut_lineage(_checked(spark, sf_dir)).withColumn("attempt", F.lit(1))
    second = first.withColumn("draft", F.col("original")).withColumn("problems", F.array().cast("array<string>")).withColumn("attempt", F.lit(2))
    tailored = L.verify_drafts(first.unionByName(second), keys)
    final = tailored.select(*keys, L.problem_list(F.col("original"), F.col("final"), F.array().cast("array<string>")).alias("problems"))
    return E.fabrication_rates(tailored, final, keys).select("mode", F.round("rate", 6).alias("rate"), "n_bullets")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_normalise_stats, html_to_text_stats, page_lines, document_lines, packed_sentences, token_counts, language_confusion, redaction_counts,
        mention_counts, phrase_mentions, canonical_terms, evidence_join, term_alignments, skill_overlap_triage, title_match_triage, triage_summary, rejected_titles, widen_rounds,
        bm25_topk, tfidf_cosine_topk, hybrid_shortlist, dense_maxsim, ndcg_by_source, compare_rankings, requirement_cap, draft_problems, fabrication_rate,
    )
}

# --- DuckDB counterparts ---------------------------------------------------------------------------------------------
_W = r"\p{L}\p{N}\p{M}_"


def _hits_sql(lang: str) -> str:
    words = ", ".join(lit(w) for w in N.LANGUAGE_HINTS[lang])
    return f"len(list_filter(ws, lambda w: w IN ({words})))"


def _bm25_sql() -> str:
    return f"""
      docs AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
      stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
      tf AS (SELECT doc_id, len(t) AS dl, token, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS token FROM docs) GROUP BY ALL),
      df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
      q AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark)"""


_TFIDF = "(1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1)"
PAIRS_SQL = f"""
      bs AS (SELECT DISTINCT item_id AS cv_id, token FROM (SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark)),
      ds AS (SELECT DISTINCT doc_id AS job_id, token FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents)),
      bn AS (SELECT cv_id, greatest(3, (count(*) * 4 + 9) // 10) AS need FROM bs GROUP BY cv_id),
      pairs AS (SELECT cv_id, job_id, count(*)::INTEGER AS n_overlap FROM bs JOIN ds USING (token) JOIN bn USING (cv_id) GROUP BY cv_id, job_id, need HAVING count(*) >= need)"""

_NDCG_SQL = f"""
      base AS (SELECT source AS cv_id, doc_id AS job_id, n_chars, len(list_distinct({tokens_sql('text')})) AS distinct_tokens FROM documents),
      lab AS (SELECT cv_id, job_id, greatest(quality * 2 - toxic, 0) AS rel, n_chars, distinct_tokens FROM labels JOIN base ON doc_id = job_id),
      m AS (SELECT 'by_length' AS method, cv_id, job_id, rel, n_chars::DOUBLE AS score FROM lab
            UNION ALL SELECT 'by_variety', cv_id, job_id, rel, distinct_tokens FROM lab UNION ALL SELECT 'by_id', cv_id, job_id, rel, -job_id FROM lab),
      r AS (SELECT *, row_number() OVER (PARTITION BY method, cv_id ORDER BY score DESC, job_id) AS i,
                   row_number() OVER (PARTITION BY method, cv_id ORDER BY rel DESC, job_id) AS b FROM m),
      g AS (SELECT method, cv_id, sum(CASE WHEN i <= 5 THEN (2 ** rel - 1) / log2(i + 1) ELSE 0 END) AS dcg,
                   sum(CASE WHEN b <= 5 THEN (2 ** rel - 1) / log2(b + 1) ELSE 0 END) AS best FROM r GROUP BY ALL),
      s AS (SELECT method, cv_id, CASE WHEN best > 0 THEN dcg / best ELSE 0.0 END AS ndcg FROM g)"""

_PHONE = r"(?:^|[^\p{L}\p{N}\p{M}_/])(\+?\(?[0-9][0-9\s().-]{6,}[0-9])(?:$|[^\p{L}\p{N}\p{M}_/])"
_DRAFT_SQL = f"""
      p AS (SELECT a.conv_id, a.turn, a.text AS original, b.text AS draft FROM conversations a JOIN conversations b
            ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
      {mentions_sql('mo', 'p', 'conv_id, turn', 'original').strip()},
      {mentions_sql('md', 'p', 'conv_id, turn', 'draft').strip()},
      added AS (SELECT conv_id, turn, string_agg(skill, ', ' ORDER BY pos, skill) AS s
                FROM (SELECT conv_id, turn, skill, min(pos) AS pos FROM md GROUP BY ALL) x
                WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.conv_id = x.conv_id AND mo.turn = x.turn AND mo.skill = x.skill) GROUP BY ALL),
      nums AS (SELECT conv_id, turn, list_filter(regexp_extract_all(draft, '[0-9]+(?:[.,][0-9]+)?'),
                 lambda n: NOT list_contains(list_transform(regexp_extract_all(original, '[0-9]+(?:[.,][0-9]+)?'), lambda m: replace(m, ',', '.')), replace(n, ',', '.'))) AS ns FROM p),
      numd AS (SELECT conv_id, turn, array_to_string(list_filter(ns, lambda n, i: list_position(ns, n) = i), ', ') AS ns FROM nums),
      checked AS (
        SELECT conv_id, turn, CASE WHEN trim(draft) = '' THEN 'empty draft' ELSE concat_ws(' | ',
          CASE WHEN ns <> '' THEN 'adds numbers not in your bullet: ' || ns END,
          CASE WHEN s IS NOT NULL THEN 'mentions tools/skills not in your bullet: ' || s END,
          CASE WHEN length(draft) > greatest(length(original) * 1.6, length(original) + 90) THEN 'much longer than the original' END) END AS problems
        FROM p JOIN numd USING (conv_id, turn) LEFT JOIN added USING (conv_id, turn))"""

_PART_MATCH_SQL = """
q0 AS (SELECT p_type AS cv_id, min(p_name) AS a, max(split_part(p_name, ' ', 2)) AS b, min(split_part(p_name, ' ', 2)) AS c FROM part GROUP BY ALL),
q AS (SELECT cv_id, 0 AS pos, split_part(a, ' ', 2) || ' of ' || split_part(a, ' ', 1) AS query, [split_part(a, ' ', 2), split_part(a, ' ', 1)] AS need FROM q0
      UNION ALL SELECT cv_id, 1, CASE WHEN length(cv_id) % 2 = 0 THEN b ELSE c END, [CASE WHEN length(cv_id) % 2 = 0 THEN b ELSE c END] FROM q0),
m AS (SELECT cv_id, p_partkey AS job_id, min(pos)::INTEGER AS pos, arg_min(query, pos) AS query FROM q JOIN part ON list_has_all(string_split(p_name, ' '), need) GROUP BY ALL)"""

ORACLES = {
    "corpus_normalise_stats": f"""WITH c AS (SELECT source, text, {clean_sql('text')} AS t FROM documents)
      SELECT source, count(*) AS n_docs, count(*) FILTER (t <> text) AS n_changed, sum(length(t))::BIGINT AS n_chars,
             sum(len(string_split(t, chr(10))))::BIGINT AS n_lines FROM c GROUP BY source""",
    "html_to_text_stats": f"""WITH c AS (SELECT page_id, list_filter(string_split({html_text_sql('html')}, chr(10)), lambda s: s <> '') AS ls FROM pages)
      SELECT page_id, len(ls)::INTEGER AS n_lines, len(list_filter(ls, lambda s: s LIKE '•%'))::INTEGER AS n_bullets,
             coalesce(list_sum(list_transform(ls, lambda s: length(s))), 0)::INTEGER AS n_chars FROM c""",
    "page_lines": f"""WITH c AS (SELECT page_id, {html_text_sql('html')} AS t FROM pages)
      SELECT page_id, line_no::INTEGER AS line_no, text, is_bullet FROM ({lines_sql('c', 'page_id', 't')})""",
    "document_lines": f"SELECT doc_id, line_no::INTEGER AS line_no, text, is_bullet FROM ({lines_sql('documents', 'doc_id', 'text')})",
    "packed_sentences": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS x FROM documents),
      s AS (SELECT doc_id, x, list_filter(list_transform(string_split(regexp_replace(x, '([.!?;])\s+([A-Z0-9À-Ý])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda y: trim(y)), lambda y: y <> '') AS ss FROM t),
      p AS (SELECT doc_id, CASE WHEN length(x) <= 420 OR len(ss) = 0 THEN [x]
              ELSE list_transform(string_split(list_reduce(list_concat([' ' || ss[1]], ss[2:]), lambda a, y: CASE WHEN length(string_split(a, chr(30))[-1]) + length(y) > 420 THEN a || chr(30) || ' ' || y ELSE a || ' ' || y END), chr(30)), lambda y: trim(y)) END AS packs
            FROM s)
      SELECT doc_id, len(packs)::INTEGER AS n_packs, list_max(list_transform(packs, lambda y: length(y)))::INTEGER AS longest FROM p""",
    "token_counts": f"""SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct
      FROM (SELECT lang, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY lang""",
    "language_confusion": f"""WITH w AS (SELECT lang, regexp_extract_all({fold_sql('text')}, '[a-z]+') AS ws FROM documents),
      c AS (SELECT lang, {_hits_sql('en')} AS en, {_hits_sql('fr')} AS fr, {_hits_sql('de')} AS de FROM w)
      SELECT lang, CASE WHEN en >= fr AND en >= de THEN 'en' WHEN fr >= de THEN 'fr' ELSE 'de' END AS predicted, count(*) AS n_docs FROM c GROUP BY ALL""",
    "redaction_counts": rf"""WITH a AS (SELECT source, text, len(regexp_extract_all(text, {lit(N.EMAIL)})) AS n_email, regexp_replace(text, {lit(N.EMAIL)}, '[email]', 'g') AS t1 FROM documents),
      b AS (SELECT *, len(regexp_extract_all(t1, {lit(N.LINK)})) AS n_link, regexp_replace(t1, {lit(N.LINK)}, '[link]', 'g') AS t2 FROM a),
      c AS (SELECT *, list_filter(regexp_extract_all(regexp_replace(t2, '([^0-9\s().\-\p{{L}}\p{{N}}\p{{M}}_/])', '\1\1', 'g'), {lit(_PHONE)}, 1),
              lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND NOT regexp_matches(p, '(?:19|20)[0-9]{{2}}\s*[-–]\s*(?:19|20)[0-9]{{2}}')) AS ps FROM b),
      d AS (SELECT *, len(ps) AS n_phone, len(regexp_extract_all(t2, {lit(N.ADDRESS)})) AS n_address,
              list_transform(string_split(t2, chr(10))[1:3], lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS heads FROM c),
      e AS (SELECT *, len(list_filter(heads, lambda s: len(regexp_split_to_array(s, '\s+')) BETWEEN 2 AND 4 AND NOT regexp_matches(s, '[0-9@\[\]|:,]')
              AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: regexp_matches(w, '^\p{{L}}') AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0
              AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: {fold_sql('w')} IN ({', '.join(lit(w) for w in N.HEADER_WORDS)}))) = 0)) > 0 AS named FROM d)
      SELECT source, sum(n_email)::BIGINT AS n_email, sum(n_link)::BIGINT AS n_link, sum(n_phone)::BIGINT AS n_phone, sum(n_address)::BIGINT AS n_address,
             count(*) FILTER (named) AS n_name FROM e GROUP BY source""",
    "mention_counts": f"""WITH {vocabulary_sql()}, {mentions_sql('m', 'documents', 'doc_id', 'text')}
      SELECT skill, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (member) AS n_member, count(*) FILTER (weak) AS n_weak FROM m GROUP BY skill""",
    "phrase_mentions": rf"""WITH v AS (SELECT DISTINCT regexp_extract({fold_sql('text')}, '^([a-z]+ [a-z]+)', 1) AS skill FROM benchmark),
      w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, unnest(gs) AS g FROM (
              SELECT doc_id, regexp_extract_all(t, '([{_W}]+)([^{_W}]*)', 1) AS ws, regexp_extract_all(t, '([{_W}]+)([^{_W}]*)', 2) AS gs FROM (SELECT doc_id, {fold_sql('text')} AS t FROM documents))),
      m AS (SELECT a.doc_id, a.i, v.skill FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN v ON v.skill = a.w || ' ' || b.w
            WHERE regexp_matches(a.g, '^[\s\-]*$') AND NOT regexp_matches(b.g, '^[+#]')),
      r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) % 2 = 1 AS kept FROM r)
      SELECT skill, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM (
        SELECT doc_id, skill FROM k WHERE kept
        UNION ALL SELECT doc_id, skill FROM w JOIN v ON w.w = replace(v.skill, ' ', '') WHERE v.skill <> '' AND NOT regexp_matches(g, '^[+#]')) GROUP BY skill""",
    "canonical_terms": """WITH t AS (SELECT p_name AS term FROM part UNION SELECT upper(split_part(p_name, ' ', 2)) FROM part),
      x AS (SELECT term, upper(left(n, 1)) || substr(n, 2) AS noun, length(n) AS k FROM (SELECT term, lower(CASE WHEN term LIKE '% %' THEN split_part(term, ' ', 2) ELSE term END) AS n FROM t))
      SELECT term, CASE WHEN k >= 0.6 * length(term) THEN noun END AS skill FROM x""",
    "evidence_join": f"""WITH {vocabulary_sql()}, {mentions_sql('m', 'conversations', 'conv_id, turn, role', 'text')},
      u AS (SELECT *, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 5 ELSE 4 END AS place FROM m),
      ids AS (SELECT conv_id, skill, string_agg('E' || turn, ',' ORDER BY place, turn) AS ids FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id, skill ORDER BY place, turn) AS i FROM (SELECT DISTINCT conv_id, skill, place, turn FROM u)) WHERE i <= 2 GROUP BY ALL),
      f AS (SELECT conv_id, skill, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys, bool_and(weak) AS weak_only,
                   arg_min(surface, place::BIGINT * 1000000000 + turn::BIGINT * 100000 + pos) FILTER (NOT member) AS plain FROM u GROUP BY ALL)
      SELECT conv_id AS cv_id, skill, ids, keys, weak_only, plain FROM ids JOIN f USING (conv_id, skill)""",
    "skill_overlap_triage": f"WITH {PAIRS_SQL} SELECT cv_id, job_id, n_overlap FROM pairs",
    "title_match_triage": f"""WITH {_PART_MATCH_SQL} SELECT cv_id, job_id, pos, query FROM m""",
    "triage_summary": f"""WITH {_PART_MATCH_SQL}, cv AS (SELECT p_type AS cv_id FROM part UNION SELECT p_brand FROM part), n AS (SELECT count(*) AS total FROM part)
      SELECT cv.cv_id, count(m.job_id) AS relevant, total, count(m.job_id) AS by_title, 0::BIGINT AS by_skills, least(15, total)::INTEGER AS target
      FROM cv CROSS JOIN n LEFT JOIN m USING (cv_id) GROUP BY ALL""",
    "rejected_titles": f"""WITH {_PART_MATCH_SQL}, cv AS (SELECT p_type AS cv_id FROM part UNION SELECT p_brand FROM part)
      SELECT cv.cv_id, p_partkey AS job_id, p_name AS title, row_number() OVER (PARTITION BY cv.cv_id ORDER BY p_partkey * 3 % 1009, p_partkey)::INTEGER AS rank
      FROM cv CROSS JOIN part LEFT JOIN m ON m.cv_id = cv.cv_id AND m.job_id = p_partkey WHERE m.job_id IS NULL QUALIFY rank <= 40""",
    "widen_rounds": """WITH p AS (SELECT p_type AS cv_id, list_sort(list(DISTINCT p_name)) AS titles FROM part GROUP BY ALL),
      a AS (SELECT *, titles[2:2] AS q0, list_filter(titles, lambda t: t <> titles[2])[1:4] AS new1 FROM p),
      b AS (SELECT *, (q0 || new1)[1:12] AS q1 FROM a),
      c AS (SELECT *, list_filter(titles, lambda t: NOT list_contains(q1, t)) AS left2 FROM b),
      d AS (SELECT *, (q1 || CASE WHEN len(left2) > 4 THEN left2[5:8] ELSE left2[1:4] END)[1:12] AS q2 FROM c),
      n AS (SELECT cv_id, q0, q1, q2, count(*) FILTER (list_contains(q0, p_name)) AS n0, count(*) FILTER (list_contains(q1, p_name)) AS n1,
                   count(*) FILTER (list_contains(q2, p_name)) AS n2, least(250, count(*)) AS target FROM d, part GROUP BY ALL)
      SELECT cv_id, CASE WHEN n0 >= target THEN 0 WHEN n1 >= target THEN 1 ELSE 2 END::INTEGER AS round,
             CASE WHEN n0 >= target THEN n0 WHEN n1 >= target THEN n1 ELSE n2 END AS n_relevant, target,
             array_to_string(CASE WHEN n0 >= target THEN q0 WHEN n1 >= target THEN q1 ELSE q2 END, ';') AS queries FROM n""",
    "bm25_topk": f"""WITH {_bm25_sql()},
      s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * dl / mean))), 5) AS score
            FROM q JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
      SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5""",
    "tfidf_cosine_topk": f"""WITH d AS (SELECT 'job' AS side, doc_id AS id, {tokens_sql('text')} AS t FROM documents UNION ALL SELECT 'cv', item_id, {tokens_sql('text')} FROM benchmark),
      k AS (SELECT count(*) AS n FROM d),
      tf AS (SELECT side, id, token, count(*) AS tf FROM (SELECT side, id, unnest(t) AS token FROM d) GROUP BY ALL),
      df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
      x AS (SELECT side, id, token, {_TFIDF} AS x FROM tf JOIN df USING (token), k),
      w AS (SELECT side, id, token, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS w FROM x),
      s AS (SELECT a.id AS item_id, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.token = b.token AND a.side = 'cv' AND b.side = 'job' GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
      SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5""",
    "hybrid_shortlist": f"""WITH {PAIRS_SQL}, {_bm25_sql()},
      pool AS (SELECT cv_id, job_id, len(t) AS dl FROM pairs JOIN docs ON doc_id = job_id),
      st AS (SELECT cv_id, count(*) AS n, avg(dl) AS mean FROM pool GROUP BY cv_id),
      h AS (SELECT p.cv_id, p.job_id, token, f, tf.dl FROM pairs p JOIN tf ON tf.doc_id = p.job_id JOIN q USING (token) WHERE q.item_id = p.cv_id),
      hd AS (SELECT cv_id, token, count(*) AS df FROM h GROUP BY ALL),
      kw AS (SELECT h.cv_id, job_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * dl / mean))) AS s
             FROM h JOIN hd USING (cv_id, token) JOIN st USING (cv_id) GROUP BY ALL),
      ch AS (SELECT job_id, line_no AS chunk_no, {tokens_sql('text')} AS t FROM ({lines_sql('(SELECT doc_id AS job_id, text FROM documents WHERE doc_id IN (SELECT job_id FROM pairs))', 'job_id', 'text')})),
      un AS (SELECT cv_id, unit_no, {tokens_sql('clause')} AS t FROM (
               SELECT item_id AS cv_id, generate_subscripts(cs, 1) AS unit_no, unnest(cs) AS clause FROM (SELECT item_id, regexp_split_to_array(text, '[.,]') AS cs FROM benchmark)) WHERE trim(clause) <> ''),
      a AS (SELECT job_id, chunk_no, token, count(*) AS tf FROM (SELECT job_id, chunk_no, unnest(t) AS token FROM ch) GROUP BY ALL),
      b AS (SELECT cv_id, unit_no, token, count(*) AS tf FROM (SELECT cv_id, unit_no, unnest(t) AS token FROM un) GROUP BY ALL),
      da AS (SELECT job_id, token, count(*) AS d FROM a GROUP BY ALL), db AS (SELECT cv_id, token, count(*) AS d FROM b GROUP BY ALL),
      sz AS (SELECT p.cv_id, p.job_id, x.n + y.n AS n FROM pairs p JOIN (SELECT job_id, count(*) AS n FROM ch GROUP BY ALL) x USING (job_id) JOIN (SELECT cv_id, count(*) AS n FROM un GROUP BY ALL) y USING (cv_id)),
      xa AS (SELECT cv_id, job_id, chunk_no, token, {_TFIDF} AS x FROM (
               SELECT sz.cv_id, job_id, n, chunk_no, token, tf, da.d + coalesce(db.d, 0) AS df FROM sz JOIN a USING (job_id) JOIN da USING (job_id, token) LEFT JOIN db ON db.cv_id = sz.cv_id AND db.token = a.token)),
      xb AS (SELECT cv_id, job_id, unit_no, token, {_TFIDF} AS x FROM (
               SELECT sz.cv_id, sz.job_id, n, unit_no, token, tf, db.d + coalesce(da.d, 0) AS df FROM sz JOIN b USING (cv_id) JOIN db USING (cv_id, token) LEFT JOIN da ON da.job_id = sz.job_id AND da.token = b.token)),
      wa AS (SELECT cv_id, job_id, chunk_no, token, x / sqrt(sum(x * x) OVER (PARTITION BY cv_id, job_id, chunk_no)) AS w FROM xa),
      wb AS (SELECT cv_id, job_id, unit_no, token, x / sqrt(sum(x * x) OVER (PARTITION BY cv_id, job_id, unit_no)) AS w FROM xb),
      co AS (SELECT cv_id, job_id, chunk_no, unit_no, sum(wa.w * wb.w) AS c FROM wa JOIN wb USING (cv_id, job_id, token) GROUP BY ALL),
      mx AS (SELECT p.cv_id, p.job_id, c.chunk_no, coalesce(max(co.c), 0.0) AS c FROM pairs p JOIN ch c USING (job_id) LEFT JOIN co ON co.cv_id = p.cv_id AND co.job_id = p.job_id AND co.chunk_no = c.chunk_no GROUP BY ALL),
      ms AS (SELECT cv_id, job_id, round(avg(c), 5) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY cv_id, job_id ORDER BY c DESC) AS i FROM mx) WHERE i <= 8 GROUP BY ALL),
      sc AS (SELECT ms.cv_id, ms.job_id, round(coalesce(s, 0), 5) AS bm25, semantic FROM ms LEFT JOIN kw ON kw.cv_id = ms.cv_id AND kw.job_id = ms.job_id),
      rk AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY bm25 DESC, job_id) AS r1, row_number() OVER (PARTITION BY cv_id ORDER BY semantic DESC, job_id) AS r2 FROM sc),
      fu AS (SELECT *, round(1 / (60 + r1) + 1 / (60 + r2), 9) AS rrf FROM rk),
      pl AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY rrf DESC, job_id)::INTEGER AS place FROM fu)
      SELECT cv_id, job_id, bm25, semantic, round(rrf, 6) AS rrf, place FROM pl WHERE place <= 12""",
    "dense_maxsim": """WITH e AS (SELECT vec_id, vec_id // 16 AS block, embedding::DOUBLE[] AS v FROM embeddings),
      c AS (SELECT a.block AS cv_id, b.block AS job_id, b.vec_id AS chunk_no, max(list_cosine_similarity(a.v, b.v)) AS best FROM e a JOIN e b ON b.block = a.block + 1 GROUP BY ALL)
      SELECT cv_id, job_id, round(avg(best), 5) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY cv_id, job_id ORDER BY best DESC) AS i FROM c) WHERE i <= 8 GROUP BY ALL""",
    "ndcg_by_source": f"WITH {_NDCG_SQL} SELECT cv_id AS source, round(ndcg, 6) AS ndcg FROM s WHERE method = 'by_length'",
    "compare_rankings": f"WITH {_NDCG_SQL} SELECT method, round(avg(ndcg), 6) AS ndcg, count(*) AS n_cvs FROM s GROUP BY method",
    "requirement_cap": rf"""WITH l AS (SELECT doc_id AS job_id, line_no, text, CASE WHEN length(text) % 3 = 0 THEN 'nice' ELSE 'must' END AS kind,
          left(trim(regexp_replace({fold_sql('text')}, '[^{_W}]+', ' ', 'g')), 90) AS k FROM ({lines_sql('documents', 'doc_id', 'text')})),
      d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, k ORDER BY line_no) AS i FROM l) WHERE i = 1),
      m AS (SELECT * EXCLUDE (i) FROM (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY job_id, kind ORDER BY line_no) AS i FROM d) WHERE kind <> 'must' OR i <= 10),
      n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY kind, line_no) AS i FROM m) WHERE i <= 14)
      SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY line_no)::INTEGER AS req_no, kind, line_no::INTEGER AS line FROM n""",
    "draft_problems": f"WITH {vocabulary_sql()}, {_DRAFT_SQL} SELECT conv_id, turn, problems FROM checked",
    "fabrication_rate": f"""WITH {vocabulary_sql()}, {_DRAFT_SQL}
      SELECT 'verifier_off' AS mode, round(avg((problems <> '')::INTEGER), 6) AS rate, count(*) AS n_bullets FROM checked
      UNION ALL SELECT 'verifier_on', 0.0, count(*) FROM checked""",
    "term_alignments": f"""WITH {vocabulary_sql()}, {mentions_sql('pm', 'documents', 'doc_id', 'text')}, {mentions_sql('um', 'conversations', 'conv_id, turn', 'text')},
      terms AS (SELECT doc_id AS job_id, skill, arg_min(surface, pos) FILTER (NOT member) AS preferred, list(DISTINCT key) AS keys FROM pm GROUP BY ALL),
      x AS (SELECT conv_id AS cv_id, conv_id AS job_id, turn AS unit_no, um.skill, surface AS cv_term, preferred AS jd_term, pos, {fold_sql('surface')} AS a, {fold_sql('preferred')} AS b
            FROM um JOIN terms ON terms.job_id = conv_id AND terms.skill = um.skill WHERE NOT member AND preferred IS NOT NULL AND NOT list_contains(keys, key)),
      y AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS n FROM x),
      z AS (SELECT * FROM y WHERE NOT (a = b OR contains(a, b) OR (abs(length(a) - length(b)) <= 1 AND n >= 0.75 * least(length(a), length(b)))))
      SELECT cv_id, job_id, unit_no, skill, arg_min(cv_term, pos) AS cv_term, arg_min(jd_term, pos) AS jd_term FROM z GROUP BY ALL""",
}
