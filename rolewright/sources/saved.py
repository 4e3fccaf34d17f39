"""The saved set: an upsert log folded to its latest state."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import rank_all

def latest_per_id(changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last change per id; of changes with one version the one with the greatest other columns. ``max_by`` combines before the shuffle, so an
    id that changes all the time is cheap."""
    body = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*body), F.struct(version, *body)).alias("s")).select(key, "s.*")


def upsert_saved(
    current: DataFrame | None,
    changes: DataFrame,
    owner: str | None = None,
    key: str = "job_id",
    version: str = "saved_at",
    limit: int | None = None,
) -> DataFrame:
    """Apply ``changes(op in save|remove|clear, …)`` to ``current``: newest first, with ``position``.

    A re-sent id replaces its row; ``remove`` drops it; ``clear`` drops all that came before it. ``limit`` is the size of a saved list: ids are taken
    in the order in which they were first saved since they were last removed or cleared, and the ones beyond it are refused
    (``refused_saves``), however often they are sent again.
    """
    kept = _arrivals(current, changes, owner, key, version)
    if limit is not None:
        kept = kept.where(F.col("__arrival") <= limit)
    return _rank(kept.drop("__arrival", "__first"), owner, [F.desc(version), F.asc(key)], "position")


def refused_saves(current: DataFrame | None, changes: DataFrame, limit: int, owner: str | None = None, key: str = "job_id", version: str = "saved_at") -> DataFrame:
    """Saved rows that a full list of ``limit`` refused, with their ``place`` in the order of arrival."""
    kept = _arrivals(current, changes, owner, key, version)
    return kept.where(F.col("__arrival") > limit).drop("__first").withColumnRenamed("__arrival", "place")


def _arrivals(current: DataFrame | None, changes: DataFrame, owner: str | None, key: str, version: str) -> DataFrame:
    """Rows that are saved now, with their place in the order of their first save since they last left the list."""
    log = changes if current is None else current.drop("position").withColumn("op", F.lit("save")).unionByName(changes, allowMissingColumns=True)
    owners = [owner] if owner else []
    cleared = log.where("op = 'clear'").groupBy(*owners).agg(F.max(version).alias("__cleared"))
    rows = log.where("op <> 'clear'")
    if owner:
        rows = rows.join(cleared, owner, "left")
    else:
        rows = rows.withColumn("__cleared", cleared.select("__cleared").scalar())
    rows = rows.where(F.col("__cleared").isNull() | (F.col(version) > F.col("__cleared"))).drop("__cleared")
    body = [c for c in rows.columns if c not in (*owners, key)]
    saved = F.col("op") == "save"
    last = rows.groupBy(*owners, key).agg(F.max_by(F.struct(*body), F.struct(version, *body)).alias("s"), F.max(F.when(~saved, F.col(version))).alias("__left"))
    first = (
        rows.where(saved)
        .join(last.select(*owners, key, "__left"), [*owners, key])
        .where(F.col("__left").isNull() | (F.col(version) > F.col("__left")))
        .groupBy(*owners, key)
        .agg(F.min(version).alias("__first"))
    )
    now = last.where("s.op = 'save'").select(*owners, key, "s.*").drop("op").join(first, [*owners, key])
    return _rank(now, owner, [F.asc("__first"), F.asc(key)], "__arrival")


def _rank(df: DataFrame, owner: str | None, order, name: str) -> DataFrame:
    """Places within a list; without owners the whole table is one list, which is ranked over many tasks whatever its size."""
    if owner:
        return rank_all(df, [owner], order, name)
    return rank_all(df.withColumn("__all", F.lit(0)), ["__all"], order, name, window_rows=0).drop("__all")


def saved_summary(saved: DataFrame) -> DataFrame:
    return saved.select(
        "job_id", "title", "company", "location", "workplace", "url", F.array_contains("tags", "Internship").alias("internship"), "saved_at"
    )


def write_saved(spark: SparkSession, saved: DataFrame, folder: str, version: int) -> str:
    """Write a new version next to the old ones; a reader takes the path it is given, so a lost job never
    leaves a half-written current set."""
    path = f"{folder.rstrip('/')}/v{version:06d}"
    saved.write.mode("errorifexists").parquet(path)
    return path


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
