"""Tables that a plan reads several times, written once below spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may leave that unset and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="glossa-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/glossa-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a work folder, read back: what it is made of is scanned once, and a lost executor costs no more than its part."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
