"""Streaming queries: run to the end of the given tables, then read the result table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.operators import merge
from shelfwise.plans import standins
from shelfwise.plans.cellar import SUMMARY
from shelfwise.plans.registry import Registry, Source
from shelfwise.sources import scratch, snapshots, tables
from shelfwise.streaming import streams

registry = Registry()
add = registry.add
BUCKETS = 8


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _stream_view(t: Source, name: str, table: str) -> DataFrame:
    return t.spark.sql(standins.VIEWS[name], **{table: _stream(t.spark, t.sf_dir, table)})


def _finish(t: Source, start, path: str) -> DataFrame:
    start(path, scratch.new_path(t.spark, "stream-state")).awaitTermination()
    return tables.read_table(t.spark, path).drop(tables.BUCKET)


@add("stream_mirror", """
SELECT cast(product_key AS string) AS product_id, CASE WHEN product_key % 3 = 1 AND product_key % 2 = 1 THEN '2026-08-02 00:00:00'
    ELSE '2026-08-03 00:00:00' END AS synced_at,
  CASE product_key % 4 WHEN 0 THEN 'stocked' WHEN 2 THEN 'limited' ELSE 'order_only' END AS availability
FROM {raw_product}
""")
def stream_mirror(t: Source) -> DataFrame:
    """Two snapshot days, of which the second lacks some products."""
    folder = scratch.new_path(t.spark, "stream-snapshots")
    first = t.raw_product.withColumn("day", F.lit("2026-08-02").cast("date"))
    second = t.raw_product.filter((F.col("product_key") % 3 != 1) | (F.col("product_key") % 2 == 0)).withColumn(
        "day", F.lit("2026-08-03").cast("date"))
    snapshots.write_snapshot(second, folder)
    snapshots.write_snapshot(first, folder)
    lines = snapshots.stream_snapshot(t.spark, f"{folder}/*", max_files=4)
    out = _finish(t, lambda path, state: streams.mirror_snapshots(lines, path, state, BUCKETS), scratch.new_path(t.spark, "stream-mirror"))
    return out.select("product_id", "synced_at", "availability")


@add("stream_mirror_children", """
WITH latest AS (SELECT p_partkey AS k, p_partkey % 3 <> 1 AS again FROM {part}),
grapes AS (SELECT k, 'G' || cast(k % 7 AS string) AS name, 0 AS pos FROM latest WHERE NOT again
  UNION ALL SELECT k, 'g' || cast(k % 5 AS string), 1 FROM latest WHERE NOT again
  UNION ALL SELECT k, 'G' || cast(k % 3 AS string), 0 FROM latest WHERE again AND k % 4 <> 0),
named AS (SELECT k, CASE lower(name) WHEN 'g1' THEN 'One' WHEN 'g2' THEN 'Two' ELSE name END AS grape, name, pos FROM grapes)
SELECT cast(k AS string) AS product_id, 'grape' AS kind, grape AS value, max_by(name, pos) AS raw_name FROM named GROUP BY 1, 2, 3
UNION ALL SELECT cast(k AS string), 'pairing', value, NULL FROM (
  SELECT k, 'P' || cast(k % 3 AS string) AS value FROM latest WHERE NOT again UNION SELECT k, 'P' || cast(k % 4 AS string) FROM latest WHERE NOT again
  UNION SELECT k, 'P' || cast(k % 2 AS string) FROM latest WHERE again AND k % 5 <> 0) p
""")
def stream_mirror_children(t: Source) -> DataFrame:
    """Two snapshot days; the second lacks some products and shortens lists of others."""
    source, folder = scratch.new_path(t.spark, "stream-lists"), scratch.new_path(t.spark, "stream-children")
    rows = t.raw_lists.select("raw", F.date_add(F.lit(date(2026, 8, 1)), F.col("day_no").cast("int")).alias("day"))
    for day_no in (2, 3):
        snapshots.write_snapshot(rows.filter(F.dayofmonth("day") == day_no), source)
    synonyms = t.spark.createDataFrame([("g1", "One"), ("g2", "Two")], "name STRING, canonical STRING")
    lines = snapshots.stream_snapshot(t.spark, f"{source}/*", max_files=2)
    streams.mirror_with_children(lines, folder, synonyms, scratch.new_path(t.spark, "stream-state"), BUCKETS).awaitTermination()
    children = [merge.read_children(t.spark, f"{folder}/{kind}", kind).withColumn("kind", F.lit(kind)).withColumnRenamed(kind, "value") for kind in ("grape", "pairing")]
    return children[0].unionByName(children[1], allowMissingColumns=True).select("product_id", "kind", "value", "raw_name")


@add("stream_ledger", SUMMARY.replace("SELECT cellar_id, wine_id,", "SELECT cellar_id, wine_id, sum(quantity) :: bigint AS quantity,"))
def stream_ledger(t: Source) -> DataFrame:
    events = _stream_view(t, "event", "events")
    return _finish(t, lambda path, state: streams.running_ledger(events, path, state, BUCKETS), scratch.new_path(t.spark, "stream-ledger"))


@add("stream_latest_stock", """
SELECT site_id, product_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, status :: bigint AS status, stock :: bigint AS stock FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, product_id ORDER BY ts DESC, status DESC, stock DESC NULLS LAST) AS n FROM {readings}) r WHERE n = 1
""")
def stream_latest_stock(t: Source) -> DataFrame:
    readings = _stream_view(t, "readings", "lineitem")
    return _finish(t, lambda path, state: streams.latest_stock(readings, path, state, BUCKETS), scratch.new_path(t.spark, "stream-stock"))
