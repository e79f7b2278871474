"""Cutting lineage so that a lost executor costs a re-read, not a wrong or failed job.

The folder comes from ``spark.checkpoint.dir`` of the session, which all executors share. On a cluster it must be set; only
on a single machine, as in tests, a folder below the warehouse directory is used where it is not.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; an error on a cluster that names none."""
    jsc = spark.sparkContext._jsc.sc()
    held = jsc.getCheckpointDir()
    if held.isDefined():
        return held.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder; later plans start from those files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session's file systems have it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
