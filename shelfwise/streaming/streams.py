"""The batch operators as Structured Streaming jobs.

Each job keeps its result as a bucketed table that every micro-batch merges
into; a replayed micro-batch leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise import spec
from shelfwise.operators import ledger, merge, normalise
from shelfwise.sources import tables
from shelfwise.sources.scratch import staged

DEFAULT_BUCKETS = 64


def _start(stream: DataFrame, apply, checkpoint: str, mode: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(apply)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def mirror_snapshots(lines: DataFrame, path: str, checkpoint: str, buckets: int = DEFAULT_BUCKETS,
                     once: bool = True) -> StreamingQuery:
    """Snapshot lines (raw, day) -> typed product table.

    Within a micro-batch the newest day of a product wins; against the table an
    older day never overwrites a newer one. Enrichment flags survive.
    """
    written = [c for c in spec.WRITTEN_COLUMNS if c != "product_id"]

    def apply(batch: DataFrame, _: int) -> None:
        dated = batch.withColumn("synced_at", F.col("day").cast("timestamp"))
        typed = normalise.normalise(dated).drop("grapes", "pairings")
        newest = merge.first_by(typed, ["product_id"], [-F.unix_timestamp("synced_at"), F.col("raw")])
        merge.upsert_table(path, newest, ["product_id"], buckets, written,
                           sort=("availability_rank", "price"), newest="synced_at")

    return _start(lines, apply, checkpoint, "append", once)


def mirror_with_children(lines: DataFrame, folder: str, synonyms: DataFrame, checkpoint: str, buckets: int = DEFAULT_BUCKETS,
                         once: bool = True) -> StreamingQuery:
    """Snapshot lines (raw, day) -> the tables product, grape, pairing and commit below ``folder``.

    A micro-batch decides once which of its products are not older than the stored ones and
    writes these, and their whole child lists, to all three tables; its number goes to
    ``commit`` last, so readers can tell the batches that are complete. If it fails between
    two tables it is replayed: the stored rows are then as new as the batch's own, the same
    products are chosen, and each table ends as if written once. A list may shrink to nothing.
    """
    written = [c for c in spec.WRITTEN_COLUMNS if c != "product_id"]

    def apply(batch: DataFrame, number: int) -> None:
        spark, product = batch.sparkSession, f"{folder}/product"
        dated = batch.withColumn("synced_at", F.col("day").cast("timestamp"))
        newest = merge.first_by(normalise.normalise(dated), ["product_id"], [-F.unix_timestamp("synced_at"), F.col("raw")])
        if tables.table_exists(spark, product):
            stored = tables.read_table(spark, product).select("product_id", F.col("synced_at").alias("_stored"))
            newest = newest.join(stored, "product_id", "left").filter(
                F.col("_stored").isNull() | (F.col("_stored") <= F.col("synced_at"))).drop("_stored")
        newest = staged(newest, "batch")
        ids = newest.select("product_id")
        merge.upsert_table(product, newest.drop("grapes", "pairings"), ["product_id"], buckets, written, sort=("availability_rank", "price"))
        merge.replace_children_table(f"{folder}/grape", normalise.grape_children(newest, synonyms), ids, buckets)
        merge.replace_children_table(f"{folder}/pairing", normalise.pairing_children(newest), ids, buckets)
        done = ids.agg(F.count(F.lit(1)).alias("products")).withColumn("batch", F.lit(number).cast("bigint"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/commit")

    return _start(lines, apply, checkpoint, "append", once)


def running_ledger(events: DataFrame, path: str, checkpoint: str, buckets: int = DEFAULT_BUCKETS,
                   once: bool = True) -> StreamingQuery:
    """Cellar events -> balance, average rating, bottles drunk and last note per wine."""
    state = events.groupBy(*ledger.KEYS).agg(ledger.balance().alias("quantity"), *ledger.summary_columns())

    def apply(batch: DataFrame, _: int) -> None:
        merge.upsert_table(path, batch, ledger.KEYS, buckets)

    return _start(state, apply, checkpoint, "update", once)


def latest_stock(readings: DataFrame, path: str, checkpoint: str, buckets: int = DEFAULT_BUCKETS,
                 lateness: str | None = None, once: bool = True) -> StreamingQuery:
    """Stock readings -> the latest per (store, product).

    Taking a maximum is idempotent, so replays are harmless. With ``lateness``
    repeated readings within the watermark are dropped first and later ones
    ignored.
    """
    keys = ["site_id", "product_id"]
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        timed = timed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([*keys, "ts", "status", "stock"])
    rest = [c for c in readings.columns if c not in keys and c != "ts"]
    latest = timed.groupBy(*keys).agg(F.max(F.struct("ts", *rest)).alias("_r"))
    flat = latest.select(*keys, "_r.*")

    def apply(batch: DataFrame, _: int) -> None:
        merge.upsert_table(path, batch, keys, buckets, newest="ts")

    return _start(flat, apply, checkpoint, "update", once)
