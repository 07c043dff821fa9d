"""Keeping the mirror current: deduplicate, merge, replace, flag, prune."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import spec
from shelfwise.sources import tables
from shelfwise.sources.scratch import staged


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    An aggregate, not a window: each map task keeps one row per key before the
    shuffle, so a key holding a large share of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def dedupe_run(df: DataFrame, key: str = "product_id",
               order: tuple[str, ...] = ("slice", "pass", "pos")) -> DataFrame:
    """A product is stored once per run; the first seen wins."""
    return first_by(df, [key], [F.col(c) for c in order])


def upsert(target: DataFrame, updates: DataFrame, key: list[str], written: list[str] | None = None) -> DataFrame:
    """Insert or replace: every written column of a matched row is taken from the
    update, NULLs included; columns the update does not write survive.

    Both sides hold one row per key.
    """
    written = written or [c for c in updates.columns if c not in key]
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns])
    u = updates.select(*[F.col(c).alias(f"_u_{c}") for c in key + written], F.lit(True).alias("_hit"))
    on = None
    for k in key:
        same = F.col(f"_t_{k}") == F.col(f"_u_{k}")
        on = same if on is None else on & same
    joined = t.join(u, on, "full_outer")
    columns = []
    for c in target.columns:
        if c in key:
            columns.append(F.coalesce(f"_t_{c}", f"_u_{c}").alias(c))
        elif c in written:
            columns.append(F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            columns.append(F.col(f"_t_{c}").alias(c))
    return joined.select(*columns)


def upsert_table(path: str, updates: DataFrame, keys: list[str], buckets: int,
                 written: list[str] | None = None, sort: tuple[str, ...] = (), newest: str | None = None) -> None:
    """``upsert`` into a bucketed table on disk, reading and rewriting touched buckets only.

    With ``newest`` an update older than the stored row (by that column) is
    ignored, so replayed or late input changes nothing.

    The touched bucket numbers are collected (at most ``buckets`` small ints) so
    that the scan prunes to those folders. The merged rows are staged first: a
    folder cannot be read and overwritten in one job, and an executor lost
    half-way must find its input again.
    """
    spark = updates.sparkSession
    if not tables.table_exists(spark, path):
        tables.write_table(updates, path, keys, buckets, sort)
        return
    # Read twice below (for its buckets, for the merge), computed once.
    updates = staged(updates, "updates")
    tagged = updates.select(tables.bucket_of(keys, buckets).alias(tables.BUCKET))
    touched = sorted(r[0] for r in tagged.distinct().collect())
    if not touched:
        return
    current = tables.read_table(spark, path).filter(F.col(tables.BUCKET).isin(touched)).drop(tables.BUCKET)
    if newest:
        stored = current.select(*keys, F.col(newest).alias("_stored"))
        updates = updates.join(stored, keys, "left").filter(
            F.col("_stored").isNull() | (F.col("_stored") <= F.col(newest))).drop("_stored")
    merged = upsert(current, updates, keys, written)
    tables.write_table(staged(merged, "merged"), path, keys, buckets, sort)


def upsert_products(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Product merge: flags that only enrichment sets are never overwritten by a sync."""
    written = [c for c in spec.WRITTEN_COLUMNS if c != "product_id" and c in updates.columns]
    return upsert(target, updates, ["product_id"], written)


def upsert_stores(target: DataFrame, updates: DataFrame, key: str = "site_id") -> DataFrame:
    """Store rows are added and refreshed, never deleted."""
    return upsert(target, updates, [key])


def replace_children(child: DataFrame, updates: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    """Drop every child row of the touched ids and add the new ones; a list can shrink to nothing."""
    touched = ids.select(key).distinct()
    return child.join(touched, key, "left_anti").unionByName(updates.select(*child.columns))


def replace_children_table(path: str, updates: DataFrame, ids: DataFrame, buckets: int, key: str = "product_id") -> None:
    """``replace_children`` on a bucketed table, reading and rewriting the buckets of ``ids`` only.

    An id that is left without children keeps one row whose other columns are NULL, so that
    its bucket is rewritten even if nothing else is in it; ``read_children`` leaves those out.
    """
    spark = ids.sparkSession
    touched = staged(ids.select(key).distinct(), "touched")
    fresh = staged(touched.join(updates, key, "left").select(*updates.columns), "children")
    if tables.table_exists(spark, path):
        numbers = [r[0] for r in touched.select(tables.bucket_of([key], buckets).alias(tables.BUCKET)).distinct().collect()]
        current = tables.read_table(spark, path).filter(F.col(tables.BUCKET).isin(numbers)).drop(tables.BUCKET)
        fresh = staged(replace_children(current, fresh, touched, key), "merged")
    tables.write_table(fresh, path, [key], buckets)


def read_children(spark, path: str, value: str) -> DataFrame:
    """A child table without the rows of ids that have no children."""
    return tables.read_table(spark, path).drop(tables.BUCKET).filter(F.col(value).isNotNull())


def set_flag(products: DataFrame, column: str, ids: DataFrame, key: str = "product_id") -> DataFrame:
    """True for the ids given, false for every other product."""
    if column not in spec.FLAG_COLUMNS:
        raise ValueError(f"refusing to set unknown flag column {column!r}")
    matched = ids.select(F.col(key).alias("_flag_id")).distinct()
    joined = products.join(matched, F.col(key) == F.col("_flag_id"), "left")
    return joined.select(*[
        F.col("_flag_id").isNotNull().alias(c) if c == column else F.col(c) for c in products.columns])


def set_store_assortment(store_product: DataFrame, assortment: DataFrame, site: str = "site_id",
                         key: str = "product_id", sites: DataFrame | None = None) -> DataFrame:
    """Replace the lists of the sites walked; pass ``sites`` when a walked site may list nothing."""
    walked = sites if sites is not None else assortment.select(site)
    fresh = assortment.groupBy(site, key).agg(F.max("synced_at").alias("synced_at"))
    return replace_children(store_product, fresh, walked, site)


def stale(products: DataFrame, cutoff: datetime, ts: str = "synced_at") -> Column:
    return F.col(ts) < F.lit(cutoff)


def prune_stale(products: DataFrame, children: dict[str, DataFrame], cutoff: datetime,
                key: str = "product_id", ts: str = "synced_at") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Remove products not seen since ``cutoff`` with their child rows.

    Returns the kept products, the kept children and a one-row count.
    """
    old = stale(products, cutoff, ts)
    gone = products.filter(old).select(key)
    kept = {name: child.join(gone, key, "left_anti") for name, child in children.items()}
    return products.filter(~old), kept, gone.agg(F.count(F.lit(1)).alias("pruned"))


def refetch_merge(first: DataFrame, retried: DataFrame, key: str = "product_id",
                  order: tuple[str, ...] = ("slice", "pass", "pos")) -> DataFrame:
    """Rows of the first sweep and of the retried slices, each product once, first sweep first."""
    both = first.withColumn("_sweep", F.lit(0)).unionByName(retried.withColumn("_sweep", F.lit(1)))
    return first_by(both, [key], [F.col("_sweep"), *[F.col(c) for c in order]]).drop("_sweep")


def run_row(run_id: int, started_at: datetime, finished_at: datetime, stored: DataFrame, audit: DataFrame,
            failures: DataFrame, snapshot_path: str | None = None, key: str = "product_id") -> DataFrame:
    """One ledger row for a run, to append to the run table: distinct products
    stored, slices walked, failures, and a note when slices were not fully covered."""
    one = F.lit("x").alias("_one")
    n = stored.agg(F.count_distinct(key).alias("products"), one)
    s = audit.agg(F.count(F.lit(1)).alias("slices"), F.count_if(~F.col("complete")).alias("_short"), one)
    e = failures.agg(F.count(F.lit(1)).alias("errors"), one)
    note = F.when(F.col("_short") > 0,
                  F.concat(F.col("_short").cast("string"), F.lit(" slices incompletely covered")))
    return n.join(s, "_one").join(e, "_one").select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(started_at).alias("started_at"),
        F.lit(finished_at).alias("finished_at"), "products", "slices", "errors",
        F.lit(snapshot_path).cast("string").alias("snapshot_path"), note.alias("note"))
