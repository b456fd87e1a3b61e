"""Lineage cuts by reliable checkpoints in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="scrivia-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode only, since executors elsewhere could not read it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local()


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
