"""Profiles, statistics, freshness and rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def profile_by(df: DataFrame, key: str, measures: dict[str, tuple[str, int]], min_n: int = 100,
               order: str | None = None) -> DataFrame:
    """(key, n, rounded averages) of groups with at least ``min_n`` rows.

    ``measures`` is ``{output: (column, decimals)}``; sorted by ``order`` descending.
    """
    averages = [F.round(F.avg(col), decimals).alias(out) for out, (col, decimals) in measures.items()]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *averages).filter(F.col("n") >= min_n)
    return out.orderBy(F.col(order).desc_nulls_last(), F.col(key)) if order else out


def stats(products: DataFrame, stores: DataFrame, grapes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: products, stores, distinct grapes and the last finished run."""
    parts = [
        products.agg(F.count(F.lit(1)).alias("products")),
        stores.agg(F.count(F.lit(1)).alias("stores")),
        grapes.agg(F.count_distinct("grape").alias("grapes")),
    ]
    if runs is not None:
        parts.append(runs.agg(F.max("finished_at").alias("last_sync")))
    out = parts[0].withColumn("_one", F.lit("x"))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit("x")), "_one")
    return out.drop("_one")


def category_counts(products: DataFrame, category: str = "cat1") -> DataFrame:
    """(category, products, stocked, order_only); the unknown category is a group."""
    return products.groupBy(category).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("availability") == "stocked").alias("stocked"),
        F.count_if(F.col("availability") == "order_only").alias("order_only"))


def freshness(products: DataFrame, as_of: date) -> DataFrame:
    """One row: products, last sync, distinct sync days (more than one means an
    interrupted sync), coming releases and the furthest launch day. One scan."""
    day = F.substring("launch_date", 1, 10)
    coming = day > as_of.isoformat()
    return products.agg(
        F.count(F.lit(1)).alias("products"),
        F.max("synced_at").alias("last_sync"),
        F.count_distinct(F.to_date("synced_at")).alias("sync_days"),
        F.count_if(coming).alias("upcoming"),
        F.max(F.when(coming, day)).alias("furthest"))


def mirrored_stores(store: DataFrame, store_product: DataFrame) -> DataFrame:
    """(site_id, name, products) of stores that have a list; a list without a store row is left out."""
    counts = store_product.groupBy("site_id").agg(F.count(F.lit(1)).alias("products"))
    return counts.join(store.select("site_id", "name"), "site_id").select("site_id", "name", "products")


def share_present(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, n, share) of rows where a column is not NULL."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                               F.round(F.avg(F.col(col).isNotNull().cast("int")), 4).alias("share"))


def list_agg(df: DataFrame, key: str, col: str, separator: str = ", ", out: str = "values") -> DataFrame:
    """(key, sorted distinct values joined).

    Distinct before joining: the result is bounded by the column's vocabulary,
    whatever the number of rows behind a key.
    """
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(col)), separator).alias(out))


def weekday_histogram(df: DataFrame, day: Column) -> DataFrame:
    """(weekday, n) with English names."""
    return df.filter(day.isNotNull()).groupBy(F.date_format(day.cast("date"), "EEEE").alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"))


def collapse_editions(df: DataFrame, keys: tuple[str, ...] = ("full_name", "producer")) -> DataFrame:
    """One row per wine over its vintages and bottle sizes."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("editions"),
        F.min("sek_per_litre").alias("best_sek_per_litre"),
        F.array_sort(F.collect_set("vintage")).alias("vintages"))


def arg_extreme(df: DataFrame, key: str, measure: Column, out: str = "value", most: bool = True, n: int = 1) -> DataFrame:
    """The group(s) with the largest (or smallest) aggregate; ties go to the smaller key.

    ``measure`` is an aggregate expression.
    """
    grouped = df.groupBy(key).agg(measure.alias(out))
    first = F.col(out).desc_nulls_last() if most else F.col(out).asc_nulls_last()
    return grouped.orderBy(first, F.col(key).asc()).limit(n)
