"""The portable catalogue: buyable products, slim columns, matching children."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from shelfwise import spec
from shelfwise.operators.search import Catalogue


def export_slim(tables: Catalogue, max_rank: int = 2, key: str = "product_id",
                columns: tuple[str, ...] = spec.SLIM_COLUMNS) -> Catalogue:
    """Products up to a rank and not discontinued, with child rows of survivors and
    mirrored stores only."""
    buyable = (F.col("availability_rank") <= max_rank) & ~F.col("is_discontinued")
    kept = tables.product.filter(buyable)
    ids = kept.select(key)
    mirrored = tables.store_product.select("site_id").distinct()
    return Catalogue(
        product=kept.select(*[c for c in columns if c in kept.columns]),
        grape=tables.grape.join(ids, key, "left_semi"),
        pairing=tables.pairing.join(ids, key, "left_semi"),
        store=tables.store.join(mirrored, "site_id", "left_semi").select("site_id", "name", "address", "city", "county"),
        store_product=tables.store_product.join(ids, key, "left_semi").select("site_id", key),
    )


def export_meta(slim: Catalogue, max_rank: int, exported_at: datetime, last_sync: str | None) -> DataFrame:
    """Provenance as (key, value) rows. The store list is one entry per mirrored store."""
    n = slim.product.agg(F.count(F.lit(1)).cast("string").alias("products"), F.lit("x").alias("_one"))
    names = slim.store.agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.col("site_id").cast("string"), "name"))), "; ")
        .alias("stores_covered"), F.lit("x").alias("_one"))
    row = n.join(names, "_one").withColumns({
        "exported_at": F.lit(exported_at.strftime("%Y-%m-%dT%H:%M:%SZ")),
        "source_sync": F.lit(last_sync),
        "max_avail_rank": F.lit(str(max_rank)),
    })
    keys = ["exported_at", "source_sync", "products", "max_avail_rank", "stores_covered"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])))


def write_export(slim: Catalogue, meta: DataFrame, path: str) -> None:
    """One folder per table."""
    for name in ("product", "grape", "pairing", "store", "store_product"):
        getattr(slim, name).write.mode("overwrite").parquet(f"{path}/{name}")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
