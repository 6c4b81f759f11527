"""Shared pieces: scratch tables in the shared folder, ASCII lower-casing, joins that stand skew."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of keys and numbers for one task. Fewer stay in one, as adaptive execution would join them: no exchange, which takes the driver a task for each of its partitions.
TASK_ROWS = 1 << 17
#: Seconds of written tables after which the driver's heap is collected.
COLLECT_S = 15
_collected = time.monotonic()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured: a temporary one in local mode (tests), an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="marketweave-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def save(df: DataFrame, partitionBy: str | None = None, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    Many small jobs in a row let the driver's heap grow to its limit before it is collected, and it doesn't shrink by itself; so it is collected every COLLECT_S seconds here.
    """
    path = f"{scratch_dir(df.sparkSession)}/mw-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=partitionBy)
    if time.monotonic() - _collected > COLLECT_S:
        release(df.sparkSession, 1)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._mw_path = path
    return out


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced, as its periodic collection does.

    The driver's heap shrinks with it; one round is enough for that.
    """
    global _collected
    for _ in range(rounds):  # what one collection finds weakly reachable, the next frees
        gc.collect()
        spark._jvm.System.gc()
        if rounds > 1:
            time.sleep(0.5)
    _collected = time.monotonic()


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in one task if `rows`, which it has at most, are few."""
    return df.coalesce(1) if rows <= TASK_ROWS else df


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._mw_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: whole texts can be long, and a batch sits in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def left_join(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join of rows to one row per key (nulls are equal), where a few keys may hold most rows.

    The groups are written first. Then both sides are plain exchanges below the join, which adaptive execution can split where a key is
    hot, and whose measured size decides whether the groups are broadcast instead.
    """
    values = [c for c in groups.columns if c != key]
    right = groups if hasattr(groups, "_mw_path") else save(groups)
    right = right.select(F.col(key).alias("_rk"), F.struct(*values).alias("_rv"))
    joined = rows.join(right, F.col(key).eqNullSafe(F.col("_rk")), "left")
    return joined.select(*rows.columns, *[F.col("_rv")[v].alias(v) for v in values])
