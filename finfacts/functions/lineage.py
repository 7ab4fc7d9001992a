"""Cutting the lineage of loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no shared folder, on a single machine only (tests, bench).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only if executors are threads of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: a lost executor doesn't cost the rounds before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that goes with the application."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
