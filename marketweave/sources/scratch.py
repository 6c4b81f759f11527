"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where that is unset, in a temporary one in local mode (tests), an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="marketweave-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/mw-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, read back: what follows neither computes it again nor carries its plan."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which stay until the driver's heap is collected. Without a JVM (Connect) nothing is done."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
