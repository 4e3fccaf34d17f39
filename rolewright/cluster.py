"""Cluster-scale helpers shared by the operators: size-checked broadcasts, distributed ranks, lineage cuts."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the counted rows, and the bytes they amount to, are bounded.

    Beyond the bound the frame comes back without a hint, so the join is a shuffle join that adaptive
    execution may re-plan and whose skewed partitions it splits. The count stops at ``max_rows + 1``.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    rows = df.limit(max_rows + 1).count()
    width = sum(_WIDTH.get(f.dataType.typeName(), 1024) for f in df.schema.fields)
    return rows <= max_rows and rows * width <= max_bytes


_WIDTH = {"integer": 4, "long": 8, "double": 8, "boolean": 1, "string": 64, "date": 4, "timestamp": 8}


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer scan partitions than the cluster has cores, before costly text work.
    A large input already has more partitions than cores and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


TASK_ROWS = 500_000


def spread_by(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out by ``keys`` over one task for each ``task_rows`` of its ``rows``, when these are more than the session's shuffle partitions: so what a task sorts
    or sums up does not grow with the table."""
    n = -(-rows // task_rows)
    return df.repartition(n, *[F.col(k) for k in keys]) if n > shuffle_tasks(df) else df


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def explode_once(array: Column) -> Column:
    """``explode`` for arrays that are costly to build. The optimiser adds ``size(array) > 0`` below a plain
    explode and so builds the array twice; the outer form gives one null row for an empty array instead."""
    return F.explode_outer(array)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation
    and every reader sees the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files next to the checkpoints, for a table with many rows and few different values that is read several times: a fraction of the
    bytes of a checkpoint, and each reader reads its own columns only."""
    path = shared_folder(df.sparkSession, f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rolewright-ckpt-"))  # a local session is one machine


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


WINDOW_ROWS = 2_000_000


def rank_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for groups of any size, see ``running_sums``."""
    return running_sums(df, keys, order, {name: F.lit(1)}, window_rows)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``sum(c) over (partition by keys order by order)``, the row itself included, for each named column of whole numbers and groups of any size. The
    order has to be total.

    The input is materialised once. When the largest group fits one task (``window_rows``) a plain window
    sums it up. Otherwise the rows are range-partitioned by (keys, order), so a hot key spans many tasks: each
    task sums its own stretch, and the offset of a stretch is the sum of that key in earlier
    partitions, read from a small (partition, key) table. The range-partitioned rows are materialised
    too, because the offsets and the sums must see identical partition bounds.
    """
    rows = cut_lineage(df)
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    whole = {n: F.sum(c.cast("long")) for n, c in sums.items()}
    upto = (W.unboundedPreceding, W.currentRow)
    if largest <= window_rows:
        every = W.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return rows.withColumns({n: c.over(every) for n, c in whole.items()})
    part = "__part"
    ordered = cut_lineage(
        rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id())
    )
    local = W.partitionBy(part, *keys).orderBy(*order).rowsBetween(*upto)
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = ordered.groupBy(part, *keys).agg(*[c.alias(f"__n_{n}") for n, c in whole.items()])
    offsets = totals.select(part, *keys, *[F.coalesce(F.sum(f"__n_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    summed = ordered.withColumns({n: c.over(local) for n, c in whole.items()}).join(offsets, [part, *keys])
    return summed.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop(part, *[f"__before_{n}" for n in sums])


def first_absent(owners: DataFrame, present: DataFrame, key: str, k: int, sums: Sequence[str] = ()) -> DataFrame:
    """(key, seq, nth and the ``sums``): the first ``k`` places, from 1 on, that an owner does not hold.

    ``present(key, seq, rank, ...)`` holds the places of each owner with their rank by place, so ``seq - rank`` places before it are absent; the j-th absent
    place lies behind all present ones with fewer than j absent ones before them. So counts by that number are all that is needed, at most ``k`` an
    owner, whatever an owner holds. ``sums`` are 0/1 columns of ``present``, summed over the places before.
    """
    counted = (
        present.withColumn("nth", F.col("seq") - F.col("rank") + 1).where(F.col("nth") <= k)
        .groupBy(key, "nth").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in sums])
    )
    places = owners.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("nth"))
    upto = W.partitionBy(key).orderBy("nth")
    every = places.join(counted, [key, "nth"], "left")
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    return every.select(key, (F.col("nth") + total("__n")).alias("seq"), "nth", *[total(c).alias(c) for c in sums])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. Spark plans a partial group limit before the shuffle, so a
    hot key sends at most ``k`` rows per map task."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def spread_hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_slice: int = 1_000_000
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Add a slice column to both sides of an equi-join so that one hot key uses many tasks.

    ``left`` rows of a key with n rows get one of ceil(n / rows_per_slice) slices; ``right`` rows of that key
    are repeated once per slice. Only keys above ``rows_per_slice`` are touched, and there are at most
    |left| / rows_per_slice of them, which bounds the table that is broadcast.
    """
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows_per_slice)
        .select(*keys, F.ceil(F.col("__n") / rows_per_slice).cast("int").alias("__slices"))
    )
    hot = checked_broadcast(hot)
    slices = F.coalesce(F.col("__slices"), F.lit(1))
    spread = left.join(hot, list(keys), "left").withColumn("__slice", F.pmod(F.xxhash64(*left.columns), slices).cast("int"))
    repeated = right.join(hot, list(keys), "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return spread.drop("__slices"), repeated.drop("__slices"), [*keys, "__slice"]
