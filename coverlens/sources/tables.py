"""Parquet table access for the driver-provided test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame, min_factor: float = 1.0) -> DataFrame:
    """Spread CPU-heavy row work over the cluster's cores.

    A scan of one large row group yields a single partition; then every
    per-row expression runs in one task.  When the input has fewer
    partitions than ``defaultParallelism``, rows are dealt round-robin to that
    many partitions.  On a cluster reading many files this is a no-op, so no
    extra exchange is added where the scan is already parallel.
    """
    target = int(df.sparkSession.sparkContext.defaultParallelism * min_factor)
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
