"""Global ranks without a single-task window.

``Window.orderBy(...)`` with no partition key moves every row into one task.
``global_rank`` instead range-partitions by the order key, numbers rows inside
each partition, and adds the row count of all earlier partitions (a table with
one row per partition, broadcast).  The order key must be a total order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.session import ensure_checkpoint_dir


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add a 1-based dense position ``name`` following ``order`` (ascending)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # monotonically_increasing_id = (partition id << 33) + index inside the partition
    local = ranged.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__idx", F.monotonically_increasing_id() - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    )
    # partition ids and positions are read twice (sizes, then offsets): pin them
    # with a reliable checkpoint in the shared folder so both reads agree and a
    # lost executor does not renumber rows
    ensure_checkpoint_dir(spark)
    local = local.checkpoint(eager=True)
    sizes = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = sizes.select(
        "__pid", (F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off")
    ).fillna(0, ["__off"])
    return (
        local.join(F.broadcast(offsets), "__pid", "inner")
        .withColumn(name, F.col("__off") + F.col("__idx") + F.lit(1))
        .drop("__pid", "__idx", "__off")
    )


def rank_within(df: DataFrame, group: str | Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position inside each ``group`` value, safe for hot groups.

    A global rank over ``(group..., order...)`` (range partitioning splits a
    large group over many tasks) minus the group's first position, taken from
    a partial+final ``min`` aggregate per group.
    """
    groups = [group] if isinstance(group, str) else list(group)
    ranked = global_rank(df, [*groups, *order], "__g")
    starts = ranked.groupBy(*groups).agg(F.min("__g").alias("__start"))
    starts = starts.withColumnsRenamed({g: f"__key_{g}" for g in groups})
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"__key_{g}")) for g in groups))  # rows of a null group keep their place
    return ranked.join(starts, same, "inner").withColumn(name, F.col("__g") - F.col("__start") + 1).drop("__g", "__start", *(f"__key_{g}" for g in groups))
