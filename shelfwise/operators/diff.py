"""What changed between two snapshots of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, change, old/new price and vintage): added, delisted, price changed,
    vintage rolled over under the same id. A product may change in two ways."""
    a = before.select(F.col(key).alias("_a"), F.col("price").alias("old_price"), F.col("vintage").alias("old_vintage"))
    b = after.select(F.col(key).alias("_b"), F.col("price").alias("new_price"), F.col("vintage").alias("new_vintage"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changes = F.array_compact(F.array(
        F.when(F.col("_a").isNull(), F.lit("added")),
        F.when(F.col("_b").isNull(), F.lit("delisted")),
        F.when(both & ~F.col("old_price").eqNullSafe(F.col("new_price")), F.lit("price")),
        F.when(both & ~F.col("old_vintage").eqNullSafe(F.col("new_vintage")), F.lit("vintage"))))
    return joined.select(F.coalesce("_a", "_b").alias(key), F.explode(changes).alias("change"),
                         "old_price", "new_price", "old_vintage", "new_vintage")
