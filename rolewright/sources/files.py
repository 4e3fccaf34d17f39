"""Snapshots, CV folders, label files and exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import POSTING, POSTING_COLUMNS, as_postings

_SNAPSHOT_ITEM = POSTING.replace("job_id string", "id string").replace(" string", ": string").replace(
    "tags array<string>", "tags: array<string>"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A JSON snapshot: ``{"note": …, "jobs": […]}`` or a bare array of postings."""
    schema = f"{_SNAPSHOT_ITEM.replace(': ', ' ')}, jobs array<struct<{_SNAPSHOT_ITEM}>>, note string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    fields = ["id", *POSTING_COLUMNS[1:]]
    wrapped = raw.where("jobs is not null").select(F.explode("jobs").alias("j")).select("j.*")
    bare = raw.where("jobs is null and id is not null").select(*fields)
    return as_postings(wrapped.select(*fields).unionByName(bare).withColumnRenamed("id", "job_id"))


def write_snapshot(postings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a snapshot as a directory, one folder per source. The ids keep their source prefix. Folders of sources that are not among the postings stay as they are, so a source
    that is read anew replaces its own postings only."""
    as_postings(postings).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").format(fmt).save(path)


def read_posting_table(spark: SparkSession, path: str, sources: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Postings of a written snapshot; with ``sources`` only their folders are listed and read."""
    found = spark.read.schema(POSTING).format(fmt).load(path)
    chosen = found.where(F.col("source").isin(*sources)) if sources is not None else found
    return chosen.select(*POSTING_COLUMNS)


def read_cvs(spark: SparkSession, folder: str) -> DataFrame:
    """(cv_id, text): one row per text file, named after the file."""
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.url_decode(name).alias("cv_id"), T.clean_text(F.col("value")).alias("text"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cv_id, job_id, rel) from ``{"cvs": {cv: {job: 0|1|2}}}``."""
    raw = spark.read.text(path, wholetext=True)
    cvs = F.from_json("value", "cvs map<string, map<string, int>>")["cvs"]
    return raw.select(F.explode(cvs).alias("cv_id", "jobs")).select("cv_id", F.explode("jobs").alias("job_id", "rel"))


def unknown_labels(labels: DataFrame, postings: DataFrame) -> DataFrame:
    """Labelled ids that are not in the pool."""
    return labels.join(postings.select("job_id"), "job_id", "left_anti")


def write_review(bullets: DataFrame, path: str) -> None:
    """Review sheet of drafted bullets, arrays joined into text, with empty label columns."""
    text = [
        F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in bullets.schema.fields
    ]
    sheet = bullets.select(*text, F.lit("").alias("label_off"), F.lit("").alias("label_on"))
    sheet.write.mode("overwrite").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
