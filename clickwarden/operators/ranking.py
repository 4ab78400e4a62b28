"""Global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed

# monotonically_increasing_id() holds the partition above this bit and the row below it
_ROW_BITS = 33


def with_global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in the given total order.

    The rows are range partitioned and sorted inside their partitions, the result is checkpointed
    so that the sampled range bounds stay fixed, and each partition adds the row count of those
    before it. Only one row per partition meets in the offset window.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    partition = F.shiftright(F.col("_place"), _ROW_BITS)
    counts = placed.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    local_row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")  # one row per shuffle partition
        .withColumn(name, F.col("_before") + local_row)
        .drop("_place", "_partition", "_before")
    )
