"""Frames cut off from what made them, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; where that is unset, a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(got)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored: plans on it start at the stored rows, and lost executors take none of them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop(df: DataFrame) -> None:
    """Delete what cut() stored, once nothing reads it any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
