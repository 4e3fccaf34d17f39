"""Stage tables in the shared folder of the cluster, and small helpers on frames."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without the setting; a cluster may not."""
    set_by_user = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_user:
        return set_by_user.rstrip("/")
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return str(in_use.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="rolewright-stages-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


ARROW_BATCH = "8m"


def prepare(spark: SparkSession) -> None:
    """Settings of a session that runs these operators: Arrow batches bounded by bytes (whole texts can be long), and Python workers of a local
    session that import this package from wherever the driver found it. On a cluster the package is installed or shipped; a path that does not exist
    there is ignored."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


SMALL_ROWS = 500_000


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: the lineage ends here, readers prune
    columns, and a lost executor costs no recomputation."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    read = df.sparkSession.read.schema(schema).parquet(path)
    read.stage_path = path
    return read


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing reads them any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(staged: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A staged table of a few numbers a row with the hint to broadcast it, if its counted rows are within the bound. Beyond it the join
    is a shuffle join with the same result."""
    return F.broadcast(staged) if staged.count() <= rows else staged


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, doc_id, text``: ``doc`` names a row by its id and text; rows that agree in both are treated alike anyway."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
