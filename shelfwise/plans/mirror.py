"""Queries of the mirror build: sources, sinks, normalisation, merging, auditing."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions import typed
from shelfwise.operators import audit, diff, export, merge, normalise, publish, sync
from shelfwise.plans.registry import Registry, Source
from shelfwise.sources import results, scratch, snapshots, synonyms, tables

registry = Registry()
add = registry.add

SYNC = datetime(2026, 8, 25, 6, 0, 0)
TIERS = [("ECONOMY", "stocked", 1), ("STANDARD", "stocked", 1), ("SMALL", "limited", 2), ("MEDIUM", "limited", 2)]


# --- sources and sinks --------------------------------------------------------

@add("snapshot_round_trip", """
SELECT cast(date_add(date '2026-08-01', cast(product_key % 3 AS int)) AS date) AS day,
  count(*) AS records, sum(product_key) :: bigint AS key_sum
FROM {raw_product} WHERE product_key % 3 <> 1 OR product_key % 2 = 0 GROUP BY 1
""")
def snapshot_round_trip(t: Source) -> DataFrame:
    path = scratch.new_path(t.spark, "snapshots")
    raw = t.raw_product.withColumn("day", F.date_add(F.lit(date(2026, 8, 1)), (F.col("product_key") % 3).cast("int")))
    snapshots.write_snapshot(raw, path)
    # A second run of one day replaces that day only.
    again = raw.filter((F.col("product_key") % 3 == 1) & (F.col("product_key") % 2 == 0))
    snapshots.write_snapshot(again, path)
    back = snapshots.read_snapshot(t.spark, path)
    keyed = normalise.typed_columns(back, {"id": ("string", "productId")}, keep=("day",))
    return keyed.groupBy("day").agg(F.count(F.lit(1)).alias("records"),
                                    F.sum(F.col("id").cast("bigint")).alias("key_sum"))


PRICE_UPDATE = """
  SELECT product_id, price, CASE WHEN product_id % 10 = 0 THEN vintage END AS vintage
  FROM {snapshot_b} WHERE product_id % 10 = 0 OR product_id > 999999999
"""
UPSERTED = f"""
SELECT coalesce(p.product_id, u.product_id) AS product_id,
  CASE WHEN u.product_id IS NOT NULL THEN u.price ELSE p.price END AS price,
  CASE WHEN u.product_id IS NOT NULL THEN u.vintage ELSE p.vintage END :: bigint AS vintage,
  p.is_vegan :: int :: bigint AS is_vegan
FROM {{product}} p FULL JOIN ({PRICE_UPDATE}) u ON u.product_id = p.product_id
"""


def _price_update(t: Source) -> DataFrame:
    b = t.snapshot_b.filter((F.col("product_id") % 10 == 0) | (F.col("product_id") > 999999999))
    return b.select("product_id", "price", F.when(F.col("product_id") % 10 == 0, F.col("vintage")).alias("vintage"))


@add("bucketed_table_upsert", UPSERTED)
def bucketed_table_upsert(t: Source) -> DataFrame:
    path = scratch.new_path(t.spark, "mirror")
    base = t.product.select("product_id", "price", "vintage", "is_vegan")
    tables.write_table(base, path, ["product_id"], 8)
    merge.upsert_table(path, _price_update(t), ["product_id"], 8, ["price", "vintage"])
    return tables.read_table(t.spark, path).drop(tables.BUCKET)


SLIM_COLUMNS = ("product_id", "full_name", "producer", "country", "cat1", "cat2", "price", "sek_per_litre",
                "availability_rank", "launch_date", "assortment_code")


@add("export_slim_products", """
SELECT product_id, full_name, producer, country, cat1, cat2, price, sek_per_litre,
  availability_rank :: bigint AS availability_rank, launch_date, assortment_code
FROM {product} WHERE availability_rank <= 2 AND NOT is_discontinued
""")
def export_slim_products(t: Source) -> DataFrame:
    return export.export_slim(t.catalogue(), 2, columns=SLIM_COLUMNS).product


@add("export_slim_children", """
WITH kept AS (SELECT product_id FROM {product} WHERE availability_rank <= 2 AND NOT is_discontinued)
SELECT 'grape' AS child, cast(product_id AS string) AS key, grape AS value FROM {grape} WHERE product_id IN (SELECT product_id FROM kept)
UNION ALL SELECT 'pairing', cast(product_id AS string), pairing FROM {pairing} WHERE product_id IN (SELECT product_id FROM kept)
UNION ALL SELECT 'store_product', cast(product_id AS string), cast(site_id AS string) FROM {store_product} WHERE product_id IN (SELECT product_id FROM kept)
UNION ALL SELECT 'store', cast(site_id AS string), city FROM {store} WHERE site_id IN (SELECT site_id FROM {store_product})
""")
def export_slim_children(t: Source) -> DataFrame:
    slim = export.export_slim(t.catalogue(), 2, columns=SLIM_COLUMNS)

    def rows(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("child"), F.col(key).cast("string").alias("key"),
                         F.col(value).cast("string").alias("value"))

    return (rows(slim.grape, "grape", "product_id", "grape")
            .unionByName(rows(slim.pairing, "pairing", "product_id", "pairing"))
            .unionByName(rows(slim.store_product, "store_product", "product_id", "site_id"))
            .unionByName(rows(slim.store, "store", "site_id", "city")))


@add("export_meta", """
WITH slim AS (SELECT product_id FROM {product} WHERE availability_rank <= 2 AND NOT is_discontinued)
SELECT 'exported_at' AS key, '2026-08-25T06:00:00Z' AS value
UNION ALL SELECT 'source_sync', '2026-08-25T06:00:00Z'
UNION ALL SELECT 'products', cast(count(*) AS string) FROM slim
UNION ALL SELECT 'max_avail_rank', '2'
UNION ALL SELECT 'stores_covered', string_agg(cast(site_id AS string) || ' ' || name, '; ' ORDER BY cast(site_id AS string) || ' ' || name)
FROM {store} WHERE site_id IN (SELECT site_id FROM {store_product})
""")
def export_meta(t: Source) -> DataFrame:
    slim = export.export_slim(t.catalogue(), 2, columns=SLIM_COLUMNS)
    return export.export_meta(slim, 2, SYNC, "2026-08-25T06:00:00Z")


@add("write_result_formats", """
SELECT f.format, p.full_name, count(*) AS n, round(avg(p.price), 2) AS avg_price
FROM {product} p, (SELECT 'csv' AS format UNION ALL SELECT 'json' UNION ALL SELECT 'table') f
GROUP BY f.format, p.full_name
""")
def write_result_formats(t: Source) -> DataFrame:
    result = t.product.groupBy("full_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 2).alias("avg_price"))
    schema = "full_name STRING, n BIGINT, avg_price DOUBLE"
    out = None
    for kind in results.FORMATS:
        path = scratch.new_path(t.spark, f"result-{kind}")
        results.write_result(result, path, kind)
        reader = t.spark.read.schema(schema)
        back = (reader.option("header", True).csv(path) if kind == "csv" else reader.json(path) if kind == "json"
                else reader.parquet(path)).withColumn("format", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@add("synonym_file", """
SELECT DISTINCT raw_name AS name,
  CASE raw_name WHEN 'bolt' THEN 'rod' WHEN 'hot' THEN 'gear' ELSE raw_name END AS canonical FROM {raw_grape}
""")
def synonym_file(t: Source) -> DataFrame:
    names = t.raw_grape.select("raw_name").distinct()
    target = F.when(F.col("raw_name") == "bolt", "rod").when(F.col("raw_name") == "hot", "gear").otherwise(F.col("raw_name"))
    line = F.concat(F.lit(" "), F.col("raw_name"), F.lit("\t"), target, F.lit(" "))
    lines = names.select(F.explode(F.array(line, F.concat(F.lit("# "), F.col("raw_name")), F.lit(""),
                                           F.concat(F.lit("lonely "), F.col("raw_name")))).alias("value"))
    path = scratch.new_path(t.spark, "synonyms")
    lines.write.text(path)
    return synonyms.read_synonyms(t.spark, path).distinct()


# --- normalisation ------------------------------------------------------------

@add("extract_typed", """
SELECT p_partkey AS product_key, cast(p_partkey AS string) AS product_id,
  CASE WHEN p_partkey % 4 >= 2 THEN p_name ELSE '' END AS name, p_brand AS name_thin,
  CASE p_partkey % 4 WHEN 1 THEN cast(p_size AS double) + 0.5e0 WHEN 2 THEN cast(p_size AS double) + 0.25e0 END AS price,
  cast(p_size * 25 AS double) AS volume_ml,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END :: bigint AS is_organic,
  CASE WHEN p_partkey % 2 = 0 THEN p_size % 13 ELSE -3 END :: bigint AS clock_body,
  CASE WHEN p_partkey % 5 <> 0 THEN 'Land' END AS country
FROM {part}
""")
def extract_typed(t: Source) -> DataFrame:
    fields = {
        "product_id": ("string", "productId"), "name": ("string", "productNameBold"),
        "name_thin": ("text", "productNameThin"), "price": ("number", "price"), "volume_ml": ("number", "volume"),
        "is_organic": ("flag", "isOrganic"), "clock_body": ("integer", "tasteClockBody"), "country": ("text", "country"),
    }
    return normalise.typed_columns(t.raw_product, fields, keep=("product_key",)).drop("raw")


@add("string_lists", """
SELECT p_partkey AS product_key,
  CASE WHEN p_partkey % 4 = 1 THEN '' ELSE cast(p_partkey AS string) END AS items FROM {part}
""")
def string_lists(t: Source) -> DataFrame:
    wrapped = t.raw_product.select("product_key", F.try_parse_json(
        F.concat(F.lit('{"grapes": '), "list_json", F.lit("}"))).alias("v"))
    return wrapped.select("product_key", typed.text_list(F.col("v"), "grapes").alias("items"))


@add("parse_vintage", """
SELECT p_partkey AS product_key, CASE WHEN p_partkey % 3 < 2 THEN 1990 + p_size END :: bigint AS vintage FROM {part}
""")
def parse_vintage(t: Source) -> DataFrame:
    return normalise.typed_columns(t.raw_product, {"vintage": ("vintage", "vintage")}, keep=("product_key",)).drop("raw")


@add("empty_text_is_null", """
SELECT CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END :: bigint AS has_country, count(*) AS n FROM {part} GROUP BY 1
""")
def empty_text_is_null(t: Source) -> DataFrame:
    out = normalise.typed_columns(t.raw_product, {"country": ("text", "country")})
    return out.groupBy(F.col("country").isNotNull().alias("has_country")).agg(F.count(F.lit(1)).alias("n"))


@add("availability_tiers", """
SELECT p_partkey AS product_key,
  CASE p_partkey % 4 WHEN 0 THEN 'stocked' WHEN 2 THEN 'limited' ELSE 'order_only' END AS availability,
  CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END :: bigint AS availability_rank
FROM {part}
""")
def availability_tiers(t: Source) -> DataFrame:
    text = normalise.typed_columns(t.raw_product, {"assortment_text": ("text", "assortmentText")}, keep=("product_key",))
    return normalise.with_availability(text).select("product_key", "availability", "availability_rank")


@add("availability_from_table", """
SELECT product_id, CASE WHEN cat2 IS NULL THEN 'order_only' ELSE availability END AS availability,
  availability_rank :: bigint AS availability_rank FROM {product}
""")
def availability_from_table(t: Source) -> DataFrame:
    lookup = t.spark.createDataFrame(TIERS, "tier STRING, availability STRING, availability_rank INT")
    return normalise.with_tiers(t.product.select("product_id", "cat2"), lookup, "tier", "cat2").drop("cat2")


@add("canonical_names", """
SELECT product_id, pos :: bigint AS pos, raw_name AS name,
  CASE raw_name WHEN 'bolt' THEN 'rod' WHEN 'hot' THEN 'gear' ELSE raw_name END AS grape FROM {raw_grape}
""")
def canonical_names(t: Source) -> DataFrame:
    lookup = t.spark.createDataFrame([("BOLT ", " rod"), (" Hot", "gear")], synonyms.SCHEMA)
    split = t.part.select(F.col("p_partkey").alias("product_id"), F.split("p_name", " ").alias("grapes"))
    return normalise.canonical(normalise.explode_names(split, "product_id", "grapes"), "name", lookup, "grape")


@add("grape_children", "SELECT product_id, grape, raw_name FROM {grape}")
def grape_children(t: Source) -> DataFrame:
    lookup = t.spark.createDataFrame([("bolt", "rod"), ("hot", "gear")], synonyms.SCHEMA)
    split = t.part.select(F.col("p_partkey").alias("product_id"), F.split("p_name", "( )").alias("grapes"))
    return normalise.grape_children(split, lookup)


@add("pairing_children", "SELECT DISTINCT product_id, raw_name AS pairing FROM {raw_grape}")
def pairing_children(t: Source) -> DataFrame:
    """Lists that name one thing twice, with blanks around it and between."""
    names = F.split("p_name", " ")
    listed = F.concat(names, F.array(F.lit("  ")), F.transform(names, lambda n: F.concat(F.lit(" "), n, F.lit(" "))))
    return normalise.pairing_children(t.part.select(F.col("p_partkey").alias("product_id"), listed.alias("pairings")))


@add("derived_prices", """
SELECT product_id, sek_per_litre,
  CASE WHEN volume_ml > 0 AND abv > 0 THEN price / (volume_ml * abv / 100.0e0 / 10.0e0) END AS sek_per_cl_alcohol
FROM {product}
""")
def derived_prices(t: Source) -> DataFrame:
    return normalise.with_derived_prices(t.product).select("product_id", "sek_per_litre", "sek_per_cl_alcohol")


@add("full_names", """
SELECT p_partkey AS product_key, CASE WHEN p_partkey % 4 >= 2 THEN p_name || ' ' || p_brand ELSE p_brand END AS full_name
FROM {part}
""")
def full_names(t: Source) -> DataFrame:
    dated = t.raw_product.withColumn("synced_at", F.lit(SYNC))
    return normalise.normalise(dated, keep=("product_key",)).select("product_key", "full_name")


@add("backfill_columns", """
SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, value FROM {events}
""")
def backfill_columns(t: Source) -> DataFrame:
    stored = t.events.select("event_id", "props", "value")
    parsed = F.try_parse_json(F.col("props"))
    added = normalise.backfill_column(stored, "k", typed.integer(parsed, "k"))
    # ``value`` is there already and is left alone.
    kept = normalise.backfill_column(added, "value", F.lit(0.0))
    return kept.select("event_id", "k", "value")


# --- merging ------------------------------------------------------------------

@add("dedupe_run", """
SELECT product_id, slice, pass :: bigint AS pass, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY slice, pass, pos) AS n FROM {walks}) w WHERE n = 1
""")
def dedupe_run(t: Source) -> DataFrame:
    return merge.dedupe_run(t.walks)


@add("upsert", UPSERTED)
def upsert(t: Source) -> DataFrame:
    base = t.product.select("product_id", "price", "vintage", "is_vegan")
    return merge.upsert(base, _price_update(t), ["product_id"], ["price", "vintage"])


@add("replace_children", """
SELECT product_id, grape, raw_name FROM {grape} WHERE product_id % 3 <> 0
UNION ALL SELECT product_id, 'new ' || grape, raw_name FROM {grape} WHERE product_id % 6 = 0
""")
def replace_children(t: Source) -> DataFrame:
    ids = t.product.filter(F.col("product_id") % 3 == 0)
    fresh = t.grape.filter(F.col("product_id") % 6 == 0).withColumn("grape", F.concat(F.lit("new "), "grape"))
    return merge.replace_children(t.grape, fresh, ids)


@add("set_flag", """
SELECT product_id, is_vegan :: int :: bigint AS is_vegan,
  CASE WHEN product_id IN (SELECT product_id FROM {pairing} WHERE pairing = 'P3') THEN 1 ELSE 0 END :: bigint AS is_kosher,
  NULL :: bigint AS is_natural
FROM {product}
""")
def set_flag(t: Source) -> DataFrame:
    never = F.lit(None).cast("boolean")
    base = t.product.select("product_id", "is_vegan", never.alias("is_kosher"), never.alias("is_natural"))
    return merge.set_flag(base, "is_kosher", t.pairing.filter(F.col("pairing") == "P3"))


@add("set_store_assortment", """
SELECT site_id, product_id FROM {store_product} WHERE site_id % 4 <> 0
UNION ALL SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem} WHERE l_suppkey % 4 = 0 AND l_linenumber = 1
""")
def set_store_assortment(t: Source) -> DataFrame:
    walked = t.store.filter(F.col("site_id") % 4 == 0).select("site_id")
    found = t.walks.filter((F.col("slice") % 4 == 0) & (F.col("pass") == 1)).select(
        F.col("slice").alias("site_id"), "product_id", F.lit(SYNC).alias("synced_at"))
    return merge.set_store_assortment(t.store_product, found, sites=walked).select("site_id", "product_id")


@add("upsert_stores", """
SELECT site_id, CASE WHEN site_id % 3 = 0 THEN upper(name) ELSE name END AS name, city FROM {store} WHERE site_id % 3 = 0 OR site_id % 2 = 0
""")
def upsert_stores(t: Source) -> DataFrame:
    rows = t.store.select("site_id", "name", "city")
    return merge.upsert_stores(rows.filter(F.col("site_id") % 2 == 0),
                               rows.filter(F.col("site_id") % 3 == 0).withColumn("name", F.upper("name")))


@add("prune_stale", """
WITH gone AS (SELECT product_id FROM {product} WHERE synced_at < timestamp '2026-08-24 00:00:00')
SELECT 'pruned' AS what, count(*) AS n FROM gone
UNION ALL SELECT 'product', count(*) FROM {product} WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'grape', count(*) FROM {grape} WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'pairing', count(*) FROM {pairing} WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'store_product', count(*) FROM {store_product} WHERE product_id NOT IN (SELECT product_id FROM gone)
""")
def prune_stale(t: Source) -> DataFrame:
    children = {"grape": t.grape, "pairing": t.pairing, "store_product": t.store_product}
    kept, kids, pruned = merge.prune_stale(t.product, children, datetime(2026, 8, 24))
    out = pruned.select(F.lit("pruned").alias("what"), F.col("pruned").alias("n"))
    for name, df in {"product": kept, **kids}.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n"))
    return out


@add("refetch_merge", """
SELECT product_id, slice, pass :: bigint AS pass, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN slice % 3 = 0 THEN 1 ELSE 0 END, slice, pass, pos) AS n
  FROM {walks}) w WHERE n = 1
""")
def refetch_merge(t: Source) -> DataFrame:
    failed = F.col("slice") % 3 == 0
    return merge.refetch_merge(t.walks.filter(~failed), t.walks.filter(failed))


# --- auditing and gates -------------------------------------------------------

@add("plan_slices", """
WITH p AS (SELECT cat1, cat2, count(*) AS n FROM {product} GROUP BY cat1, cat2),
w AS (SELECT cat1, sum(n) :: bigint AS total FROM p GROUP BY cat1)
SELECT cat1, NULL :: string AS cat2, total AS expected, 0 :: bigint AS over_cap FROM w WHERE total < 330
UNION ALL SELECT p.cat1, p.cat2, p.n, CASE WHEN p.cat2 IS NOT NULL AND p.n >= 330 THEN 1 ELSE 0 END
FROM p JOIN w ON p.cat1 IS NOT DISTINCT FROM w.cat1 WHERE w.total >= 330
""")
def plan_slices(t: Source) -> DataFrame:
    return audit.plan_slices(t.product, cap=330)


AUDIT = """
WITH first AS (SELECT slice, product_id, min(pass) AS pass FROM {walks} GROUP BY slice, product_id),
fresh AS (SELECT slice, pass, count(*) AS n FROM first GROUP BY slice, pass),
per AS (SELECT w.slice, w.pass, w.rows, coalesce(f.n, 0) AS n, e.expected,
    sum(coalesce(f.n, 0)) OVER (PARTITION BY w.slice ORDER BY w.pass) AS seen,
    sum(w.rows) OVER (PARTITION BY w.slice ORDER BY w.pass) AS total,
    row_number() OVER (PARTITION BY w.slice ORDER BY w.pass) AS nth
  FROM (SELECT slice, pass, count(*) AS rows FROM {walks} GROUP BY slice, pass) w
  LEFT JOIN fresh f ON f.slice = w.slice AND f.pass = w.pass JOIN {expected} e ON e.slice = w.slice),
stop AS (SELECT slice, coalesce(min(CASE WHEN (expected > 0 AND seen >= expected) OR n = 0 THEN nth END), max(nth)) AS nth
  FROM per GROUP BY slice),
audit AS (SELECT p.slice, p.expected, p.total :: bigint AS rows, p.seen :: bigint AS unique_ids, p.nth AS passes,
    CASE WHEN p.expected > 0 AND p.seen >= p.expected THEN 1 ELSE 0 END :: bigint AS complete
  FROM per p JOIN stop s ON s.slice = p.slice AND s.nth = p.nth)
"""


@add("coverage_audit", AUDIT + "SELECT * FROM audit")
def coverage_audit(t: Source) -> DataFrame:
    return audit.coverage_audit(t.walks, t.expected)


@add("prune_gate", AUDIT + """
SELECT f.failures, a.incomplete, CASE WHEN f.failures = 0 AND a.incomplete = 0 THEN 1 ELSE 0 END :: bigint AS prune
FROM (SELECT count(*) AS incomplete FROM audit WHERE complete = 0) a,
     (SELECT count(*) AS failures FROM {readings} WHERE status = 503) f
""")
def prune_gate(t: Source) -> DataFrame:
    return audit.prune_gate(audit.coverage_audit(t.walks, t.expected), t.readings.filter(F.col("status") == 503))


@add("run_ledger", AUDIT + """
SELECT 7 :: bigint AS run_id, (SELECT count(DISTINCT product_id) FROM {walks}) AS products, a.slices,
  (SELECT count(*) FROM {readings} WHERE status = 503) AS errors,
  cast(a.short AS string) || ' slices incompletely covered' AS note
FROM (SELECT count(*) AS slices, count(*) FILTER (WHERE complete = 0) AS short FROM audit) a
""")
def run_ledger(t: Source) -> DataFrame:
    return merge.run_row(7, SYNC, SYNC, t.walks, audit.coverage_audit(t.walks, t.expected),
                         t.readings.filter(F.col("status") == 503)).select("run_id", "products", "slices", "errors", "note")


@add("publish_gate", """
SELECT a.products, b.live, CASE WHEN a.products < 1000 OR (b.live > 0 AND a.products < b.live // 2) THEN 0 ELSE 1 END :: bigint AS publish,
  CASE WHEN a.products < 1000 THEN 'too few products' WHEN b.live > 0 AND a.products < b.live // 2 THEN 'fewer than half of the live products' END AS reason
FROM (SELECT count(*) AS products FROM {snapshot_b}) a, (SELECT count(*) AS live FROM {pairing}) b
""")
def publish_gate(t: Source) -> DataFrame:
    return audit.publish_gate(t.snapshot_b, t.pairing)


def _gate_sql(step: int, count: str, before: str) -> str:
    """One step of ``publish_version``: the count, what was live, the verdict, and what is live afterwards."""
    live = f"(SELECT served FROM {before})" if before else "0"
    number = f"(SELECT number FROM {before})" if before else "NULL"
    return f"""s{step} AS (SELECT *, CASE WHEN publish = 1 THEN products ELSE live END AS served,
    CASE WHEN publish = 1 THEN coalesce(old, 0) + 1 ELSE old END :: bigint AS number
  FROM (SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END :: bigint AS publish
    FROM (SELECT {step} :: bigint AS step, products, live, old, CASE WHEN products < 1000 THEN 'too few products'
        WHEN live > 0 AND products < live // 2 THEN 'fewer than half of the live products' END AS reason
      FROM (SELECT ({count}) :: bigint AS products, {live} :: bigint AS live, {number} :: bigint AS old))))"""


@add("publish_version", "WITH " + ", ".join([
    _gate_sql(1, "SELECT count(*) FROM {product}", ""), _gate_sql(2, "SELECT count(*) FROM {product} WHERE price < 1000", "s1"),
    _gate_sql(3, "SELECT count(*) FROM {snapshot_b}", "s2")]) + "".join(f"""
{"UNION ALL " * (i > 1)}SELECT step, products, live, publish, reason, number, served, (SELECT served FROM s1) AS held FROM s{i}""" for i in (1, 2, 3)))
def publish_version(t: Source) -> DataFrame:
    """A whole table, a crawl that found the cheapest only, and the next day's table; held is what the first day's reader still reads."""
    root, rows, held = scratch.new_path(t.spark, "published"), [], None
    steps = (t.product, t.product.filter("price < 1000"), t.snapshot_b)
    for step, products in enumerate(steps, 1):
        verdict = publish.publish(root, {"product": products}).first()
        now = publish.live(t.spark, root)
        held = held if step > 1 else now
        count = lambda version: version.table("product").count() if version else 0
        rows.append((step, *verdict, count(now), count(held)))
    return t.spark.createDataFrame(rows, "step long, products long, live long, publish boolean, reason string, number long, served long, held long")


@add("snapshot_diff", """
WITH j AS (SELECT coalesce(a.product_id, b.product_id) AS product_id, a.product_id AS old_id, b.product_id AS new_id,
    a.price AS old_price, b.price AS new_price, a.vintage :: bigint AS old_vintage, b.vintage :: bigint AS new_vintage
  FROM {product} a FULL JOIN {snapshot_b} b ON a.product_id = b.product_id)
SELECT product_id, 'added' AS change, old_price, new_price, old_vintage, new_vintage FROM j WHERE old_id IS NULL
UNION ALL SELECT product_id, 'delisted', old_price, new_price, old_vintage, new_vintage FROM j WHERE new_id IS NULL
UNION ALL SELECT product_id, 'price', old_price, new_price, old_vintage, new_vintage FROM j
  WHERE old_id IS NOT NULL AND new_id IS NOT NULL AND old_price IS DISTINCT FROM new_price
UNION ALL SELECT product_id, 'vintage', old_price, new_price, old_vintage, new_vintage FROM j
  WHERE old_id IS NOT NULL AND new_id IS NOT NULL AND old_vintage IS DISTINCT FROM new_vintage
""")
def snapshot_diff(t: Source) -> DataFrame:
    return diff.snapshot_diff(t.product, t.snapshot_b)


SYNC_RUNS = """
WITH w AS (SELECT DISTINCT slice, product_id FROM {walks}),
half AS (SELECT slice, product_id, min(pos % 2) AS odd FROM {walks} GROUP BY slice, product_id),
names AS (SELECT DISTINCT product_id, grape, pos FROM (
  SELECT product_id, pos, CASE raw_name WHEN 'bolt' THEN 'rod' WHEN 'hot' THEN 'gear' ELSE raw_name END AS grape FROM {raw_grape}) g),
p1 AS (SELECT DISTINCT product_id FROM w),
p2 AS (SELECT DISTINCT product_id FROM half WHERE slice % 9 <> 0 OR odd = 0),
p3 AS (SELECT DISTINCT product_id FROM w WHERE product_id % 17 <> 0),
g1 AS (SELECT DISTINCT product_id, grape FROM names WHERE product_id IN (SELECT product_id FROM p1)),
g3 AS (SELECT DISTINCT product_id, grape FROM names WHERE product_id IN (SELECT product_id FROM p3) AND (pos = 0 OR product_id % 6 <> 0)),
s1 AS (SELECT * FROM w),
s3 AS (SELECT * FROM w WHERE product_id % 17 <> 0 AND (slice % 4 <> 0 OR product_id % 2 = 0)),
size AS (SELECT (SELECT count(*) FROM p1) AS n1, (SELECT count(*) FROM p3) AS n3, (SELECT count(DISTINCT slice) FROM w) AS slices,
  (SELECT count(DISTINCT slice) FROM w WHERE slice % 9 = 0) AS broken)
SELECT 1 :: bigint AS run_id, n1 AS products, slices, 0 :: bigint AS errors, NULL :: string AS note, 0 :: bigint AS pruned,
  1 :: bigint AS publish, NULL :: string AS reason, 1 :: bigint AS number, n1 AS served, (SELECT count(*) FROM g1) AS grapes,
  (SELECT count(*) FROM s1) AS carried, (SELECT count(*) FROM p1 WHERE product_id % 5 = 0) AS kosher FROM size
UNION ALL SELECT 2, (SELECT count(*) FROM p2), slices, broken, NULL, 0, 0, cast(broken AS string) || ' failures', 1, n1,
  (SELECT count(*) FROM g1), (SELECT count(*) FROM s1), (SELECT count(*) FROM p1 WHERE product_id % 5 = 0) FROM size
UNION ALL SELECT 3, n3, slices, 0, NULL, n1 - n3, 1, NULL, 2, n3,
  (SELECT count(*) FROM g3), (SELECT count(*) FROM s3), (SELECT count(*) FROM p3 WHERE product_id % 10 = 0) FROM size
"""


@add("sync_runs", SYNC_RUNS)
def sync_runs(t: Source) -> DataFrame:
    """Three days: a whole walk; one with broken slices, of which some break again; a whole one in which products,
    grapes and listings are gone. Each run's row, and what readers are served after it."""
    root = scratch.new_path(t.spark, "sync")
    lookup = t.spark.createDataFrame([("bolt", "rod"), ("hot", "gear")], synonyms.SCHEMA)
    product, slice_ = F.col("product_id"), F.col("slice")
    names = t.part.select(F.col("p_partkey").alias("product_id"), F.split("p_name", " ").alias("names"))
    raw = t.raw_product.select(F.col("product_key").alias("product_id"), "raw").join(names, "product_id")

    def records(names_read: F.Column) -> DataFrame:
        """The day's records, each with the names given as its grapes, wherever a walk comes by them."""
        named = F.concat(F.expr("substring(raw, 1, length(raw) - 1)"), F.lit(', "grapes": '), F.to_json(names_read), F.lit("}"))
        found = t.walks.select("slice", F.lit(1).alias("pass"), "pos", "product_id").join(raw.select("product_id", named.alias("raw")), "product_id")
        return scratch.staged(found, "walk")  # as an extraction leaves it: records, ids, listings and expectations are read from it

    def expected(found: DataFrame) -> DataFrame:
        return found.groupBy("slice").agg(F.count_distinct("product_id").alias("expected"))

    def ids(found: DataFrame) -> DataFrame:
        return found.select(product.cast("string").alias("product_id")).distinct()

    def listed(found: DataFrame) -> DataFrame:
        return found.select(slice_.cast("bigint").alias("site_id"), product.cast("string").alias("product_id"))

    first, last = records(F.slice("names", 1, 2)), records(F.when(product % 6 == 0, F.slice("names", 1, 1)).otherwise(F.slice("names", 1, 2)))
    third = last.filter(product % 17 != 0)
    slices = t.walks.select("slice").distinct()
    again, twice = slices.filter(slice_ % 3 == 0), slices.filter(slice_ % 9 == 0)
    fourth = slices.filter(slice_ % 4 == 0).select(slice_.cast("bigint").alias("site_id"))
    walks = [
        sync.Walk(first, expected(first), flags={"is_kosher": ids(first.filter(product % 5 == 0))},
                  sites=slices.select(slice_.cast("bigint").alias("site_id")), assortment=listed(first)),
        sync.Walk(first.filter((slice_ % 3 != 0) | (F.col("pos") % 2 == 0)), expected(first), failed=again, failed_again=twice,
                  retried=first.filter((slice_ % 3 == 0) & (slice_ % 9 != 0))),
        sync.Walk(third, expected(third), flags={"is_kosher": ids(third.filter(product % 10 == 0))}, sites=fourth,
                  assortment=listed(third.filter((slice_ % 4 == 0) & (product % 2 == 0)))),
    ]
    out = None
    for day, walk in enumerate(walks):
        run = sync.sync(root, day + 1, SYNC + timedelta(days=day), walk, lookup, minimum=100)
        now = publish.live(t.spark, root)
        size = now.table("product").agg(F.count(F.lit(1)).alias("served"), F.count_if(F.col("is_kosher")).alias("kosher")).first()
        row = run.drop("started_at", "finished_at").withColumns({
            "served": F.lit(size.served), "grapes": F.lit(now.table("grape").count()),
            "carried": F.lit(now.table("store_product").count()), "kosher": F.lit(size.kosher)})
        out = row if out is None else out.unionByName(row)
    return out
