"""Running sums and ranks that do not need one task per key.

A plain window over a key sorts and scans all of the key's rows in one task.
Here rows are cut into blocks that follow the order; the window runs inside a
(key, block) pair and the blocks before it come in as one offset, computed from
one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def block_offsets(df: DataFrame, keys: list[str], block: str, value: Column, out: str) -> DataFrame:
    """(keys, block, out): the sum of ``value`` over all earlier blocks of the key."""
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, block, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(out))


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` plus the inclusive running sum of ``value`` per key in the given order.

    ``block`` must be non-decreasing in ``order`` within a key; NULL-free.
    """
    offsets = block_offsets(df, keys, block, value, "_offset")
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inside", F.sum(value).over(inside))
    joined = summed.join(offsets, [*keys, block])
    return joined.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(out))


def price_block(price: Column) -> Column:
    """An order-preserving block number for prices: sixteen blocks per doubling."""
    return F.floor(F.log2(F.greatest(price, F.lit(1.0))) * 16)


def cumulative_count(rows: DataFrame, group: str, value: str, points: DataFrame) -> DataFrame:
    """(…, below): for every point (_ref, _cat, _price) the rows of its group with a
    smaller value.

    Rows and points are first reduced to one row per distinct (group, value), so
    the running sum is over distinct values, not over rows.
    """
    counts = rows.groupBy(F.col(group).alias("_cat"), F.col(value).alias("_price")).agg(
        F.count(F.lit(1)).alias("_n"))
    asked = points.select("_cat", "_price").distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = counts.unionByName(asked).groupBy("_cat", "_price").agg(F.sum("_n").alias("_n"))
    # NULL is a group of its own; joins below need a NULL-free key.
    keyed = both.withColumn("_known", F.col("_cat").isNotNull()).withColumn("_key", F.coalesce("_cat", F.lit("")))
    blocked = keyed.withColumn("_block", price_block(F.col("_price")))
    running = running_sum(blocked, ["_known", "_key"], "_block", ["_price"], F.col("_n"), "_upto")
    below = running.select(F.col("_cat").alias("_c"), F.col("_price").alias("_p"),
                           (F.col("_upto") - F.col("_n")).alias("below"))
    return points.join(below, F.col("_cat").eqNullSafe(F.col("_c")) & (F.col("_price") == F.col("_p"))).select(
        *points.columns, "below")


def previous_value(df: DataFrame, keys: list[str], block: str, order: str, value: str, out: str) -> DataFrame:
    """``df`` plus the preceding row's value per key; NULL on a key's first row.

    Inside a block a window; across blocks the last value of the block before,
    taken from one summary row per block.
    """
    lasts = df.groupBy(*keys, block).agg(F.max_by(value, order).alias("_last"))
    over_blocks = Window.partitionBy(*keys).orderBy(block)
    carried = lasts.select(*keys, block, F.lag("_last").over(over_blocks).alias("_carried"))
    inside = Window.partitionBy(*keys, block).orderBy(order)
    stepped = df.withColumn("_lag", F.lag(value).over(inside)).withColumn("_nth", F.row_number().over(inside))
    joined = stepped.join(carried, [*keys, block])
    return joined.select(*df.columns, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(out))


def numbered(df: DataFrame, keys: list[str], block: str, order: list[str], out: str) -> DataFrame:
    """``df`` plus 1, 2, 3 ... per key in the given (total) order."""
    return running_sum(df, keys, block, order, F.lit(1), out)
