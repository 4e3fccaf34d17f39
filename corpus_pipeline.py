"""From documents to packed training sequences: STAGES, each written as Parquet and reread as the next one's docs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewright.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from rolewright.llm.stage import prepare, stage

#: The model of language ID learns from the documents that its query learns from.
LANG_FOLDS, LANG_HELD_OUT = 3, 1
WORDS, PERCENT = 5, 80


def _row(docs: DataFrame) -> str:
    """A name that no column of the documents has."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _named(docs: DataFrame, row: str) -> DataFrame:
    """All columns of documents and ``row``, the hash by which the operators name a row."""
    return docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but for those whose hash is listed. A merge join at every size: one plan, whose cost grows as the texts do."""
    row = _row(docs)
    listed = stage(rows.distinct().toDF(row), "left-out")
    return _named(docs, row).join(listed.hint("merge"), row, "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the model rejects go, among them those without letters, null and empty texts. Repeated rows share their fate, rows that share an id do not; other columns stay
    as they are, whatever their names. An empty table stays empty."""
    prepare(spark)
    model = language_id.fit(docs, language_id.fold("doc_id", LANG_FOLDS) != LANG_HELD_OUT)
    # the judged text is found again by row, not by id: ids may repeat
    rows = _named(docs, _row(docs)).select(F.col(_row(docs)).alias("doc_id"), "text")
    return _without(docs, language_id.identify(rows, model).where("rejected").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeated runs of three lines, or of fewer with fifty words, are cut out of the texts; a document that loses all its lines goes. Null and empty texts have
    no lines to lose and stay. Order is that of ids, null ids first; repeated rows count as one document and lose the same lines."""
    prepare(spark)
    found = line_dedup.remove_repeated_lines(docs, carry=tuple(docs.columns), words=line_dedup.WORDS)
    cut = F.size("removed") > 0
    found = found.where(~cut | (F.trim(F.translate("kept_text", "\n\t\r", "   ")) != ""))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select([F.when(cut, changed[c]).otherwise(F.col(f"carried.{c}")).alias(c) if c in changed else F.col(f"carried.{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: of each group of linked documents one row stays, that of the least id (null ids last; of rows with one id the one with the least hash of
    id and text; of rows equal in both the first by their other columns). Texts without words are linked with nothing; of them only repeated rows go."""
    prepare(spark)
    row = _row(docs)
    found = stage(ngram_join.similar_documents(docs, WORDS, PERCENT).select("doc", "doc_id", "root"), "components")
    stays = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")).alias("first"))
    gone = found.join(stays, "root").where(F.col("doc") != F.col("first.doc")).select("doc")
    left = _without(docs, gone)
    # rows repeated as a whole share a hash; only these are ordered by their other columns
    named = _named(left, row)
    twice = stage(named.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row), "repeated-rows")
    again = named.join(twice.hint("merge"), row)
    whole = F.struct(*docs.columns)
    once = again.groupBy(row).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return named.join(twice.hint("merge"), row, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of ten words of a benchmark item go. Null and empty texts hold none. An empty benchmark removes nothing."""
    prepare(spark)
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _named(docs, _row(docs)).select(F.col(_row(docs)).alias("doc_id"), "text")
    return _without(docs, decontaminate.contamination(rows, tests).where(F.size("hit") > 0).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every piece of every document that is left, with its sequence and offset; an empty text is one piece, its end of text."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: Language ID and packing can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
