"""Structured Streaming jobs: incremental posting ingest, run-event statistics, scoring of arriving postings.

State is bounded by watermarks; sinks go through ``foreachBatch`` and write versioned folders, so a batch that
is replayed after a failure overwrites its own output only.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..cluster import shuffle_tasks
from ..operators.triage import shared_skills
from ..sources.saved import latest_per_id


def read_landing(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json", only: str = "*", max_files: int = 1000
) -> DataFrame:
    """Stream of the files that land in a folder, with an explicit schema; ``only`` is a file-name pattern."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", only)
    return reader.format(fmt).load(path)


def start_ingest(
    arriving: DataFrame, normalise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    key: str = "job_id", event_time: str = "landed_at", late: str = "1 day",
) -> StreamingQuery:
    """Normalise arriving postings and append their changes, one folder per batch.

    A version re-sent within ``late`` is dropped in the stream; any other becomes a new version, also one that goes back to an
    earlier content, or a later one with the same.
    ``current_postings`` folds the versions, so no batch rewrites the table.
    """
    rows = normalise(arriving)
    hashed = rows.withColumn("content_hash", F.xxhash64(*[c for c in rows.columns if c != event_time]))
    fresh = hashed.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key, event_time, "content_hash"])

    def append(batch: DataFrame, batch_id: int) -> None:
        latest_per_id(batch.withColumn("batch_id", F.lit(batch_id)), key, event_time).write.mode("overwrite").parquet(
            f"{out.rstrip('/')}/batch={batch_id:08d}"
        )

    return (
        fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_postings(spark: SparkSession, out: str, key: str = "job_id", event_time: str = "landed_at") -> DataFrame:
    """Latest version of every ingested posting."""
    versions = spark.read.parquet(f"{out.rstrip('/')}/batch=*")
    return latest_per_id(versions, key, event_time).drop("batch_id", "content_hash")


def stage_windows(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Counts, mean duration and latest status of run events per tumbling window. Works on a stream (late events
    beyond the watermark are dropped) and on a table."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum("ms").alias("total_ms"),
            F.max_by("status", "seq").alias("last_status"),
        )
        .select(F.col("w.start").alias("window_start"), *by, "n_events", "total_ms", "last_status")
    )


def start_windows(events: DataFrame, out: str, checkpoint: str, **kw) -> StreamingQuery:
    """Write every window that a batch changed as a new version, one folder per batch; ``current_windows`` folds them. So the last window is there too, as far as it has come, and
    a replayed batch replaces its own folder."""
    rows = stage_windows(events, **kw)
    return _versions(rows.writeStream.outputMode("update"), out, checkpoint)


def current_windows(spark: SparkSession, out: str, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Latest version of every window."""
    versions = spark.read.parquet(f"{out.rstrip('/')}/batch=*")
    keys = ["window_start", *by]
    whole = F.struct(*[c for c in versions.columns if c not in keys and c != "batch_id"])
    return versions.groupBy(*keys).agg(F.max_by(whole, "batch_id").alias("v")).select(*keys, "v.*")


def _versions(writer, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id:08d}")

    return writer.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_ends(events: DataFrame, timeout: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("run_id", "node")) -> DataFrame:
    """(by, started, start_seq, finished, end_seq, status) of run events ``(by, status, ts, seq)``: each start with every end (``done`` or ``failed``) of the same stage within ``timeout``; a start
    without one is given up, with nulls, when the watermark says that none can come. A stream-stream join in an interval, so state is bounded by ``timeout`` and
    ``late``; events later than ``late`` are dropped."""
    starts = events.where("status = 'start'").select(*by, F.col("ts").alias("started"), F.col("seq").alias("start_seq")).withWatermark("started", late)
    ends = events.where("status in ('done', 'failed')").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("ts").alias("finished"), F.col("seq").alias("end_seq"), "status")
    ends = ends.withWatermark("finished", late)
    same = F.expr(" and ".join([f"{c} = __{c}" for c in by] + ["finished >= started", f"finished <= started + interval {timeout}"]))
    return starts.join(ends, same, "left_outer").select(*by, "started", "start_seq", "finished", "end_seq", "status")


def start_durations(events: DataFrame, out: str, checkpoint: str, **kw) -> StreamingQuery:
    """Append the ends that ``stage_ends`` finds, one folder per batch."""
    return _versions(stage_ends(events, **kw).writeStream.outputMode("append"), out, checkpoint)


def stage_durations(spark: SparkSession, out: str, by: tuple[str, ...] = ("run_id", "node")) -> DataFrame:
    """(by, started, start_seq, finished, ms, status): every start with its first end, ``timed out`` without one. Starts that may still end are not there yet."""
    first = F.min_by(F.struct("finished", "status"), F.struct("finished", "end_seq")).alias("e")
    found = spark.read.parquet(f"{out.rstrip('/')}/batch=*").groupBy(*by, "started", "start_seq").agg(first)
    ms = F.floor((F.unix_micros("e.finished") - F.unix_micros("started")) / 1000)
    return found.select(*by, "started", "start_seq", F.col("e.finished").alias("finished"), ms.alias("ms"), F.coalesce("e.status", F.lit("timed out")).alias("status"))


def start_scoring(
    arriving: DataFrame, cv_skills: DataFrame, job_skills_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, threshold=None, key: str = "job_id", event_time: str | None = None
) -> StreamingQuery:
    """Triage arriving postings against a static table of candidate skills, batch by batch.

    A batch writes its pairs and the ids it holds, both under its number, so a replayed batch replaces its own folders; ``current_pairs`` takes the pairs of the last batch that held a
    posting: one that is sent again replaces its pairs, also by none. With ``event_time`` the latest version of an id counts within a batch.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        # a batch may be one file, which few tasks read; dealt out by its key, what is made of a posting stays where its text is
        spread = batch.repartition(max(batch.sparkSession.sparkContext.defaultParallelism, shuffle_tasks(batch), batch.rdd.getNumPartitions()), key)
        rows = latest_per_id(spread, key, event_time) if event_time else spread
        held = job_skills_of(rows)
        pairs = shared_skills(cv_skills, held, threshold) if threshold else shared_skills(cv_skills, held)
        for name, table in (("pairs", pairs), ("seen", rows.select(F.col(key).alias("job_id")).distinct())):
            table.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={batch_id:08d}")

    return arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pairs(spark: SparkSession, out: str) -> DataFrame:
    """(cv_id, job_id, n_overlap, shared) of the last version of every posting."""
    read = lambda name: spark.read.parquet(f"{out.rstrip('/')}/{name}/batch=*")
    last = read("seen").groupBy("job_id").agg(F.max("batch_id").alias("batch_id"))
    return read("pairs").join(last, ["job_id", "batch_id"], "left_semi").select("cv_id", "job_id", "n_overlap", "shared")


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
