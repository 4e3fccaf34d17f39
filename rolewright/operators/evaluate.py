"""Ranking quality and fabrication rates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import top_k


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def ndcg(ranked: DataFrame, labels: DataFrame, k: int = 5, keys: tuple[str, ...] = ("cv_id",)) -> DataFrame:
    """(keys, ndcg) at ``k``. ``ranked(keys, job_id, score)``, ``labels(keys, job_id, rel)``; only labelled postings
    are ranked, ties by id. Both orders are top-k windows, so a group of any size sends k rows per task."""
    x = ranked.join(labels, [*keys, "job_id"])
    by_score = top_k(x, keys, [F.desc("score"), F.asc("job_id")], k, "i")
    ideal = top_k(x, keys, [F.desc("rel"), F.asc("job_id")], k, "i")

    def dcg(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(gain(F.col("rel")) / F.log2(F.col("i") + 1)).alias(name))

    return dcg(by_score, "dcg").join(dcg(ideal, "best"), list(keys)).select(
        *keys, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg")
    )


def compare_rankings(methods: dict[str, DataFrame], labels: DataFrame, k: int = 5) -> DataFrame:
    """(method, ndcg, n_cvs): mean NDCG of each ranking ``(cv_id, job_id, score)``."""
    rows = None
    for name, df in methods.items():
        part = df.select(F.lit(name).alias("method"), "cv_id", "job_id", "score")
        rows = part if rows is None else rows.unionByName(part)
    per_cv = ndcg(rows.join(labels, ["cv_id", "job_id"]).select("method", "cv_id", "job_id", "score"),
                  rows.select("method", "cv_id").distinct().join(labels, "cv_id"), k, ("method", "cv_id"))
    return per_cv.groupBy("method").agg(F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n_cvs"))


def with_tie_break(fit: DataFrame, rrf: DataFrame) -> DataFrame:
    """Final score of the full match: fit, with the retrieval score deciding ties."""
    return fit.join(rrf.select("cv_id", "job_id", "rrf"), ["cv_id", "job_id"]).select(
        "cv_id", "job_id", (F.col("fit") + 1e-3 * F.col("rrf")).alias("score")
    )


def fabrication_rates(tailored: DataFrame, final_problems: DataFrame, keys: list[str]) -> DataFrame:
    """(mode, rate, n_bullets): share of bullets with problems, first draft against final text."""
    x = tailored.join(final_problems.select(*keys, (F.size("problems") > 0).alias("on_violation")), keys)
    return (
        x.select(F.explode(F.array(
            F.struct(F.lit("verifier_off").alias("mode"), F.col("off_violation").alias("bad")),
            F.struct(F.lit("verifier_on").alias("mode"), F.col("on_violation").alias("bad")),
        )).alias("m"))
        .groupBy("m.mode")
        .agg(F.avg(F.col("m.bad").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_bullets"))
    )
