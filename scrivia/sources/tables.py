"""Table loading, additive schema evolution and the domain's view of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where they come in fewer partitions than there are cores, as from one file of one row group; a larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < cores else df


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The schema's columns, cast; missing ones take their default."""
    given = defaults or {}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def parse_json(text: Column, schema: str) -> Column:
    """A struct, or null where the text is no such JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications: status, competition, participant, judge and time."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "judge_in_review").otherwise("submitted")
    judge = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 10)
    return o.select(F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("participant_id"), F.col("o_orderpriority").alias("competition_key"), status.alias("status"), judge.alias("judge_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("updated_at"))
