"""Registered queries of the operators, each over its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewright.llm import decontaminate, exact_dedup, fill_in_middle, language_id, line_dedup, nearest, ngram_join, packing, spelling, suffix_dedup, token_counts, toxicity, url_filter
from rolewright.llm.oracles import ORACLES as ORACLES
from rolewright.llm.stage import prepare

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = language_id.fold("doc_id", 3)
    found = language_id.identify(docs, language_id.fit(docs, fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_table(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model, url_filter.PRODUCTION_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90).drop("doc", "root")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), language_id.fold("doc_id", 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), words=line_dedup.WORDS)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents after white space is normalised: who stays, how many there are, and the hash of the text."""
    return exact_dedup.digest(exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, one letter taken out of one run in 97, with their near words, forms and roots."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spoil=spelling.SPOIL)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at line ends and reordered, with the hash of the text that is rebuilt from the output."""
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), unit="line", seed=7))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}
