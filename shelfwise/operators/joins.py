"""Joins of the catalogue with its child tables and with other row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_children(df: DataFrame, child: DataFrame, key: str = "product_id") -> DataFrame:
    """One row per product and child row (inner)."""
    return df.join(child, key)


def carried_by_pivot(products: DataFrame, store_product: DataFrame, sites: dict[str, object],
                     key: str = "product_id", site: str = "site_id") -> DataFrame:
    """One 0/1 column per site: ``{output column: site id}``; products no site carries are kept.

    Only the asked sites' rows are aggregated, to one row per product, before the join.
    """
    flags = [F.max(F.when(F.col(site) == value, 1).otherwise(0)).alias(f"_{name}") for name, value in sites.items()]
    carried = (store_product.filter(F.col(site).isin(*sites.values()))
               .groupBy(F.col(key).alias("_carried")).agg(*flags))
    joined = products.join(carried, F.col(key) == F.col("_carried"), "left")
    return joined.select(*products.columns, *[F.coalesce(f"_{n}", F.lit(0)).alias(n) for n in sites])


def count_per_row(left: DataFrame, right: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Each left row with its number of right rows, 0 where there is none."""
    counts = right.groupBy(F.col(key).alias("_ckey")).agg(F.count(F.lit(1)).alias("_n"))
    joined = left.join(counts, F.col(key) == F.col("_ckey"), "left")
    return joined.select(*left.columns, F.coalesce("_n", F.lit(0)).alias(out))


def attach_listing(wines: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """What is sold today under each wine's product id: listed_vintage, listed_price,
    listed_availability and same_vintage; NULL where nothing is.

    Wines without a product id take no part in the join: all those NULL keys
    would meet in one task.
    """
    listed = products.filter(~F.col("is_discontinued")).select(
        F.col(key).alias("_listed"), F.col("vintage").alias("listed_vintage"),
        F.col("price").alias("listed_price"), F.col("availability").alias("listed_availability"))
    known = wines.filter(F.col(key).isNotNull()).join(listed, F.col(key) == F.col("_listed"), "left")
    same = F.when(F.col("_listed").isNotNull(), F.col("vintage").eqNullSafe(F.col("listed_vintage")))
    out = known.select(*wines.columns, "listed_vintage", "listed_price", "listed_availability",
                       same.alias("same_vintage"))
    types = {f.name: f.dataType for f in out.schema}
    alone = wines.filter(F.col(key).isNull()).select(*wines.columns, *[
        F.lit(None).cast(types[c]).alias(c)
        for c in ("listed_vintage", "listed_price", "listed_availability", "same_vintage")])
    return out.unionByName(alone)


def cheaper_counts(refs: DataFrame, products: DataFrame, category: str = "cat2", price: str = "price",
                   key: str = "product_id", cheaper_only: bool = True) -> DataFrame:
    """Per reference, how many candidates it has: same category, another id and,
    where the reference's price is known, cheaper. (key, candidates)

    The range join is a lookup in a cumulative histogram of (category, price):
    references and prices meet on equal keys only, and no candidate pair is
    formed.
    """
    from shelfwise.operators.running import cumulative_count

    ref = refs.select(F.col(key).alias("_ref"), F.col(category).alias("_cat"), F.col(price).alias("_price"))
    limited = ref.filter(F.col("_price").isNotNull()) if cheaper_only else ref.limit(0)
    below = cumulative_count(products.filter(F.col(price).isNotNull()), category, price,
                             limited.select("_ref", "_cat", "_price"))
    unlimited = ref.filter(F.col("_price").isNull()) if cheaper_only else ref
    totals = products.groupBy(F.col(category).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    own = products.select(F.col(key).alias("_own"), F.col(category).alias("_own_cat")).withColumn("_one", F.lit(1))
    whole = (unlimited.join(totals, F.col("_cat").eqNullSafe(F.col("_c")), "left")
             .join(own, (F.col("_ref") == F.col("_own")) & F.col("_cat").eqNullSafe(F.col("_own_cat")), "left")
             .select("_ref", (F.coalesce("_n", F.lit(0)) - F.coalesce("_one", F.lit(0))).alias("candidates")))
    return below.select("_ref", F.col("below").alias("candidates")).unionByName(whole).withColumnRenamed("_ref", key)
