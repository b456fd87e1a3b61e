"""State changes as writes: partitions replaced whole, and purges by key, both safe to run again after a break."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.lineage import shared_folder


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows to the Parquet table at path; each partition (keys) that rows have is replaced whole, the others stay. Running it again changes nothing."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def store(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes rows in partitions by a hash of their key, so that a purge rewrites only the partitions in which it finds something."""
    replace_partitions(rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), path, ["_bucket"])


def stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of a stored table; a bucket left empty keeps one row without a key, which is none of them."""
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop("_bucket")


def purge(spark: SparkSession, path: str, key: str, gone: DataFrame, of: str) -> None:
    """Takes the rows out whose key is among gone's. Survivors of the buckets concerned are written aside and then replace them, so a break leaves every bucket as it was or purged; running it again ends it."""
    table = spark.read.parquet(path)
    keys = gone.select(F.col(of).alias("_gone")).filter("_gone is not null").distinct()
    hit = table.join(keys, F.col(key) == F.col("_gone"), "left_semi").select(F.col("_bucket").alias("_hit")).distinct()
    concerned = table.join(F.broadcast(hit), F.col("_bucket") == F.col("_hit"), "left_semi")
    left = concerned.join(keys, F.col(key) == F.col("_gone"), "left_anti").filter(F.col(key).isNotNull())
    empty = hit.select(*(F.col("_hit").alias("_bucket") if f.name == "_bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))
    aside = f"{shared_folder(spark)}/purge-{uuid.uuid4().hex}"
    left.unionByName(empty).write.parquet(aside)
    replace_partitions(spark.read.parquet(aside), path, ["_bucket"])


def purge_cascade(spark: SparkSession, children: list[tuple[str, str]], parent: tuple[str, str], gone: DataFrame, of: str) -> None:
    """Purges (path, key) tables by one set of keys: the children first, so that after a break the parent still tells which keys are to go."""
    for path, key in [*children, parent]:
        purge(spark, path, key, gone, of)
