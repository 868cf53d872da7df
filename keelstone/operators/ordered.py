"""Lag and running sums per entity that do not need the whole entity in one task.

The order is cut into blocks by its first, numeric column. Windows run inside a block; what has to
cross a border is one row per (entity, block), and only those rows are windowed per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocked(df: DataFrame, order: list[str], width: float) -> DataFrame:
    return df.withColumn("block_", F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(1 << 62))).cast("bigint"))


def lag_by_block(df: DataFrame, entity: str, order: list[str], value: str, out: str, width: float = 100_000) -> DataFrame:
    """df with out, the value of the row before in the order; null for the first of an entity. Rows
    whose first order column is null come first. order must tell all rows of an entity apart for
    the result to be the same each time."""
    b = _blocked(df, order, width)
    inside = Window.partitionBy(entity, "block_").orderBy(*order)
    tails = b.groupBy(entity, "block_").agg(F.max_by(value, F.struct(*order)).alias("tail_"))
    tails = tails.withColumn("carried_", F.lag("tail_").over(Window.partitionBy(entity).orderBy("block_"))).drop("tail_")
    rows = b.withColumn("no_", F.row_number().over(inside)).withColumn("lag_", F.lag(value).over(inside)).join(tails, [entity, "block_"], "left")
    return rows.withColumn(out, F.when(F.col("no_") == 1, F.col("carried_")).otherwise(F.col("lag_"))).drop("block_", "no_", "lag_", "carried_")


def running_sum_by_block(df: DataFrame, entity: str, order: list[str], value: Column, out: str, width: float = 100_000) -> DataFrame:
    """df with out, the sum of value over the rows up to and with this one."""
    b = _blocked(df, order, width).withColumn("value_", value)
    inside = Window.partitionBy(entity, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = b.groupBy(entity, "block_").agg(F.sum("value_").alias("sum_"))
    earlier = Window.partitionBy(entity).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0))).drop("sum_")
    rows = b.withColumn("in_", F.sum("value_").over(inside)).join(sums, [entity, "block_"], "left")
    return rows.withColumn(out, F.col("in_") + F.col("before_")).drop("block_", "value_", "in_", "before_")
