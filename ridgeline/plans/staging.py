"""Intermediate tables: computed once, kept in the folder that driver and executors share, so that lineage stays short."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of a few numbers a row is broadcast up to so many rows (about 20 MB), and shuffled beyond.
BROADCAST_ROWS = 500_000


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import this library, wherever the driver was started; a cluster gets it by --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where there is none, a temporary folder, which only a local master can use."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        context.setCheckpointDir(found)
    return found


def staged_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/ridgeline-{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. DataFrames that read them, results included, can't be used after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again. The table stays until clear_staged(), or until the folder is cleaned."""
    path = f"{staged_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
