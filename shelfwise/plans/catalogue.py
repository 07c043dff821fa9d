"""Queries of the catalogue: filters, joins, text, similarity, releases, stores, aggregates, paging."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions import taste
from shelfwise.functions.text import Term, text_match, tokenise
from shelfwise.operators import aggregates, filters, index, joins, search, sqlapi
from shelfwise.operators.similar import find_similar
from shelfwise.plans.registry import Registry, Source
from shelfwise.sources import scratch

registry = Registry()
add = registry.add

AS_OF = date(2026, 8, 25)
SYNC = datetime(2026, 8, 25, 6, 0, 0)

LISTED = """product_id, full_name, producer, country, cat1, cat2, cat3, vintage :: bigint AS vintage, price, volume_ml, abv,
  availability, availability_rank :: bigint AS availability_rank, clock_body :: bigint AS clock_body,
  clock_tannin :: bigint AS clock_tannin, clock_sweetness :: bigint AS clock_sweetness,
  clock_fruitacid :: bigint AS clock_fruitacid, taste"""
SHELF = "availability_rank <= 1 AND NOT is_discontinued"


# --- scans and predicates -----------------------------------------------------

@add("common_filters", """
SELECT product_id, price FROM {product} p WHERE availability_rank <= 2 AND NOT is_discontinued
  AND (cat1 = 'A' OR cat2 = 'A') AND country = 'NATION_3' AND price >= 905 AND price <= 1050
  AND EXISTS (SELECT 1 FROM {store_product} s WHERE s.product_id = p.product_id AND s.site_id = 3)
""")
def common_filters(t: Source) -> DataFrame:
    return filters.common_filters(t.product, 2, "A", "NATION_3", 905.0, 1050.0, 3, t.store_product).select("product_id", "price")


@add("name_match", "SELECT product_id, full_name FROM {product} WHERE full_name ILIKE '%RING%' OR producer ILIKE '%RING%'")
def name_match(t: Source) -> DataFrame:
    return filters.name_match(t.product, "RING").select("product_id", "full_name")


@add("clock_range", """
SELECT product_id FROM {product} WHERE clock_body >= 3 AND clock_body <= 9 AND clock_tannin >= 2 AND clock_tannin <= 10
  AND clock_sweetness <= 8 AND clock_fruitacid >= 3
""")
def clock_range(t: Source) -> DataFrame:
    return filters.clock_range(t.product, 3, 9, 2, 10, 8, 3).select("product_id")


@add("dietary", "SELECT product_id FROM {product} WHERE is_organic AND is_vegan")
def dietary(t: Source) -> DataFrame:
    return filters.dietary(t.product, organic=True, vegan=True).select("product_id")


@add("list_columns", f"SELECT {LISTED} FROM {{noted}}")
def list_columns(t: Source) -> DataFrame:
    return filters.list_columns(t.noted)


@add("rated_only", "SELECT product_id, clock_body :: bigint AS clock_body FROM {product} WHERE clock_body > 0")
def rated_only(t: Source) -> DataFrame:
    return filters.rated_only(t.product).select("product_id", "clock_body")


@add("taste_bands", """
SELECT product_id, array_to_string(list_filter([
  CASE WHEN clock_body <= 6 THEN 'light' END, CASE WHEN clock_body BETWEEN 6 AND 8 THEN 'medium' END,
  CASE WHEN clock_body >= 9 THEN 'full-bodied' END, CASE WHEN clock_tannin <= 4 THEN 'smooth' END,
  CASE WHEN clock_tannin BETWEEN 5 AND 7 THEN 'some structure' END, CASE WHEN clock_tannin >= 8 THEN 'structured' END,
  CASE WHEN clock_sweetness <= 2 THEN 'dry' END, CASE WHEN clock_sweetness BETWEEN 3 AND 6 THEN 'off-dry' END,
  CASE WHEN clock_sweetness >= 7 THEN 'sweet' END, CASE WHEN clock_fruitacid >= 8 THEN 'fresh' END,
  CASE WHEN clock_fruitacid <= 5 THEN 'soft' END, CASE WHEN clock_smokiness >= 7 THEN 'smoky' END,
  CASE WHEN clock_bitter >= 8 THEN 'bitter' END], lambda x: x IS NOT NULL), '|') AS bands FROM {product}
""")
def taste_bands(t: Source) -> DataFrame:
    return t.product.select("product_id", taste.taste_bands().alias("bands"))


@add("budget_bands", """
SELECT product_id, CASE WHEN price / 5 < 100 THEN 'everyday' WHEN price / 5 < 200 THEN 'sweet spot' WHEN price / 5 < 400 THEN 'occasion'
  WHEN price / 5 >= 400 THEN 'splurge' END AS band FROM {product}
""")
def budget_bands(t: Source) -> DataFrame:
    return t.product.select("product_id", taste.budget_band(F.col("price") / 5).alias("band"))


@add("dosage_bands", """
SELECT cellar_id, wine_id, array_to_string(list_filter([CASE WHEN sugar_g_l < 3 THEN 'Brut Nature' END,
  CASE WHEN sugar_g_l BETWEEN 0 AND 6 THEN 'Extra Brut' END, CASE WHEN sugar_g_l < 12 THEN 'Brut' END,
  CASE WHEN sugar_g_l BETWEEN 12 AND 17 THEN 'Extra Dry' END, CASE WHEN sugar_g_l BETWEEN 17 AND 32 THEN 'Sec' END,
  CASE WHEN sugar_g_l BETWEEN 32 AND 50 THEN 'Demi-Sec' END, CASE WHEN sugar_g_l > 50 THEN 'Doux' END],
  lambda x: x IS NOT NULL), '|') AS bands FROM {wine}
""")
def dosage_bands(t: Source) -> DataFrame:
    return t.wine.select("cellar_id", "wine_id", taste.dosage_bands(F.col("sugar_g_l")).alias("bands"))


STYLES = {
    "red ring": (("red", "ring"), (), None),
    "small from two": (("small",), ("NATION_1", "NATION_2"), None),
    "plain gear": (("gear",), (), "the"),
}


@add("style_preset", """
SELECT product_id FROM {noted} p WHERE NOT coalesce(list_contains(regexp_extract_all(strip_accents(lower(taste)), '[\\p{L}\\p{N}]+'), 'the'), false)
  AND product_id IN (SELECT product_id FROM {grape} WHERE grape = 'gear')
""")
def style_preset(t: Source) -> DataFrame:
    return filters.style_preset(t.noted, t.grape, "plain gear", STYLES).select("product_id")


@add("styles_of", """
SELECT product_id, 'red ring' AS style FROM {product} WHERE product_id IN (SELECT product_id FROM {grape} WHERE grape = 'red')
  AND product_id IN (SELECT product_id FROM {grape} WHERE grape = 'ring')
UNION ALL SELECT product_id, 'small from two' FROM {product} WHERE country IN ('NATION_1', 'NATION_2')
  AND product_id IN (SELECT product_id FROM {grape} WHERE grape = 'small')
UNION ALL SELECT product_id, 'plain gear' FROM {noted}
  WHERE NOT coalesce(list_contains(regexp_extract_all(strip_accents(lower(taste)), '[\\p{L}\\p{N}]+'), 'the'), false)
  AND product_id IN (SELECT product_id FROM {grape} WHERE grape = 'gear')
""")
def styles_of(t: Source) -> DataFrame:
    return filters.styles_of(t.noted, t.grape, STYLES)


# --- joins --------------------------------------------------------------------

@add("with_children", """
SELECT p.product_id, p.full_name, c.site_id, r.pairing, g.grape FROM {product} p JOIN {store_product} c USING (product_id)
JOIN {pairing} r USING (product_id) JOIN {grape} g USING (product_id) WHERE r.pairing = 'P3'
""")
def with_children(t: Source) -> DataFrame:
    base = t.product.select("product_id", "full_name")
    stores = joins.with_children(base, t.store_product.select("product_id", "site_id"))
    pairs = joins.with_children(stores, t.pairing.filter(F.col("pairing") == "P3"))
    return joins.with_children(pairs, t.grape.select("product_id", "grape"))


@add("having", "SELECT product_id FROM {product} WHERE product_id IN (SELECT product_id FROM {grape} WHERE grape = 'rod')")
def having(t: Source) -> DataFrame:
    return filters.having(t.product, t.grape, "product_id", "grape", "rod").select("product_id")


@add("having_not", """
SELECT product_id FROM {product} WHERE product_id IN (SELECT product_id FROM {pairing} WHERE pairing = 'P3')
  AND product_id NOT IN (SELECT product_id FROM {pairing} WHERE pairing = 'P7')
""")
def having_not(t: Source) -> DataFrame:
    some = filters.having(t.product, t.pairing, "product_id", "pairing", "P3")
    return filters.having_not(some, t.pairing, "product_id", "pairing", "P7").select("product_id")


@add("carried_by_pivot", """
SELECT p.product_id, max(CASE WHEN s.site_id = 3 THEN 1 ELSE 0 END) :: bigint AS store_3,
  max(CASE WHEN s.site_id = 4 THEN 1 ELSE 0 END) :: bigint AS store_4
FROM {product} p LEFT JOIN {store_product} s ON s.product_id = p.product_id GROUP BY p.product_id
""")
def carried_by_pivot(t: Source) -> DataFrame:
    return joins.carried_by_pivot(t.product.select("product_id"), t.store_product, {"store_3": 3, "store_4": 4})


CANDIDATE_COUNTS = """
SELECT r.product_id, count(c.product_id) AS candidates FROM {product} r
LEFT JOIN {product} c ON c.cat2 IS NOT DISTINCT FROM r.cat2 AND c.product_id <> r.product_id
  AND (r.price IS NULL OR c.price < r.price)
GROUP BY r.product_id
"""


@add("candidate_counts", CANDIDATE_COUNTS)
def candidate_counts(t: Source) -> DataFrame:
    return joins.cheaper_counts(t.product, t.product)


@add("count_per_row", """
SELECT s.site_id, (SELECT count(*) FROM {store_product} p WHERE p.site_id = s.site_id) AS products FROM {store} s
""")
def count_per_row(t: Source) -> DataFrame:
    return joins.count_per_row(t.store.select("site_id"), t.store_product, "site_id", "products")


LISTING = """
SELECT w.cellar_id, w.wine_id, p.vintage :: bigint AS listed_vintage, p.price AS listed_price, p.availability AS listed_availability,
  CASE WHEN p.product_id IS NOT NULL THEN CASE WHEN p.vintage IS NOT DISTINCT FROM w.vintage THEN 1 ELSE 0 END END :: bigint AS same_vintage
FROM {wine} w LEFT JOIN (SELECT * FROM {product} WHERE NOT is_discontinued) p ON p.product_id = w.product_id
"""


@add("attach_listing", LISTING)
def attach_listing(t: Source) -> DataFrame:
    wines = t.wine.select("cellar_id", "wine_id", "product_id", "vintage")
    return joins.attach_listing(wines, t.product).drop("product_id", "vintage")


# --- text ---------------------------------------------------------------------

def _tokens(col: str) -> str:
    return f"coalesce(regexp_extract_all(strip_accents(lower({col})), '[\\p{{L}}\\p{{N}}]+'), [])"


@add("tokenise", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) d GROUP BY token
""")
def tokenised(t: Source) -> DataFrame:
    words = t.documents.select(F.explode(tokenise(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@add("text_match", f"""
SELECT doc_id FROM (SELECT doc_id, {_tokens('text')} AS a, {_tokens('lang')} AS b, {_tokens('source')} AS c FROM documents) d
WHERE ((list_contains(a, 'the') OR list_contains(b, 'the') OR list_contains(c, 'the')) AND list_contains(a, 'of')
    AND (list_contains(a, 'en') OR list_contains(b, 'en') OR list_contains(c, 'en')))
  AND NOT contains(' ' || array_to_string(a, ' ') || ' ', ' to the ')
""")
def text_match_query(t: Source) -> DataFrame:
    expr = (Term("THE") & Term("of").in_columns("text") & Term("en")).without(Term("to the").in_columns("text"))
    return text_match(t.documents, expr, ("text", "lang", "source")).select("doc_id")


@add("text_folding", f"""
SELECT doc_id FROM (SELECT doc_id, {_tokens('text')} AS a FROM documents) d WHERE list_contains(a, 'on') OR list_contains(a, 'ou')
""")
def text_folding(t: Source) -> DataFrame:
    return text_match(t.documents, Term("ón") | Term("OÙ"), ("text",)).select("doc_id")


@add("inverted_index", f"""
SELECT term, count(*) AS documents FROM (
  SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents) d GROUP BY term
""")
def inverted_index(t: Source) -> DataFrame:
    return index.document_frequency(index.inverted_index(t.documents, "doc_id", ("text",))).select("term", "documents")


@add("index_search", f"""
WITH d AS (SELECT doc_id, list_concat({_tokens('text')}, {_tokens('source')}) AS a FROM documents)
SELECT 'all' AS mode, doc_id FROM d WHERE list_contains(a, 'the') AND list_contains(a, 'of') AND list_contains(a, 'on')
UNION ALL SELECT 'any', doc_id FROM d WHERE list_contains(a, 'que') OR list_contains(a, 'les')
UNION ALL SELECT 'without', doc_id FROM d WHERE list_contains(a, 'the') AND NOT list_contains(a, 'to')
""")
def index_search(t: Source) -> DataFrame:
    path = scratch.new_path(t.spark, "index")
    index.write_index(index.inverted_index(t.documents, "doc_id", ("text", "source")), path, 16)
    stored = index.read_index(t.spark, path, 16)
    found = {"all": index.search_all(stored, "doc_id", "the OF on"), "any": index.search_any(stored, "doc_id", "que les"),
             "without": index.search_without(stored, "doc_id", "the", "to")}
    out = None
    for mode, df in found.items():
        rows = df.select(F.lit(mode).alias("mode"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- search -------------------------------------------------------------------

SEARCH = search.Search(category="A", pairing="P3", exclude_grape="ring", min_price=901.0, max_sweetness=11, sort="value",
                       limit=50, max_availability_rank=3)
SEARCH_WHERE = """availability_rank <= 3 AND NOT is_discontinued AND (cat1 = 'A' OR cat2 = 'A') AND price >= 901 AND clock_sweetness <= 11
  AND product_id IN (SELECT product_id FROM {pairing} WHERE pairing = 'P3')
  AND product_id NOT IN (SELECT product_id FROM {grape} WHERE grape = 'ring')"""


@add("search_products", f"""
SELECT {LISTED} FROM {{noted}} WHERE {SEARCH_WHERE} ORDER BY sek_per_litre NULLS FIRST, product_id LIMIT 50
""")
def search_products(t: Source) -> DataFrame:
    return search.search_products(t.catalogue("noted"), SEARCH).items


@add("search_products_page", f"""
SELECT count(*) AS total, least(greatest(count(*) - 100, 0), 50) AS count, 100 :: bigint AS offset,
  CASE WHEN count(*) > 150 THEN 1 ELSE 0 END :: bigint AS has_more, CASE WHEN count(*) > 150 THEN 150 END :: bigint AS next_offset
FROM {{product}} WHERE {SEARCH_WHERE}
""")
def search_products_page(t: Source) -> DataFrame:
    found = search.matching_products(t.catalogue(), SEARCH)
    return search.page(found, search.sort_order("value"), 50, 100).meta


@add("search_notes", f"""
SELECT {LISTED} FROM (SELECT *, {_tokens('taste')} AS a FROM {{noted}}) p
WHERE availability_rank <= 3 AND NOT is_discontinued AND cat1 = 'B' AND list_contains(a, 'the') AND list_contains(a, 'of')
  AND NOT list_contains(a, 'retion') ORDER BY price NULLS FIRST, product_id LIMIT 100
""")
def search_notes(t: Source) -> DataFrame:
    expr = (Term("the") & Term("of")).in_columns("taste").without(Term("retion").in_columns("taste"))
    return search.search_notes(t.noted, expr, max_rank=3, category="B", limit=100).items


def _distance(side: str) -> str:
    return " + ".join(f"abs(coalesce({side}.{c}, {d}) - coalesce(r.{c}, {d}))" for c, d in (
        ("clock_body", 6), ("clock_tannin", 6), ("clock_sweetness", 0), ("clock_fruitacid", 6)))


def _similar(k: int, cheaper: bool) -> str:
    limit = "AND (r.price IS NULL OR c.price < r.price)" if cheaper else ""
    return f"""
WITH s AS (SELECT product_id, list(DISTINCT grape) AS gs FROM {{grape}} GROUP BY product_id),
pairs AS (
  SELECT r.product_id AS ref_id, c.product_id, ({_distance('c')}) :: bigint AS distance,
    len(list_intersect(rs.gs, cs.gs)) :: bigint AS shared_grapes, c.price
  FROM {{product}} r JOIN {{product}} c ON c.cat2 IS NOT DISTINCT FROM r.cat2 AND c.product_id <> r.product_id
    AND NOT c.is_discontinued {limit}
  JOIN s rs ON rs.product_id = r.product_id JOIN s cs ON cs.product_id = c.product_id),
ranked AS (SELECT ref_id, product_id, shared_grapes, distance, row_number() OVER (PARTITION BY ref_id
  ORDER BY shared_grapes DESC, distance, price NULLS FIRST, product_id) AS rank FROM pairs)
SELECT ref_id, rank, product_id, shared_grapes, distance FROM ranked WHERE rank <= {k}
"""


@add("find_similar", _similar(6, True))
def similar_cheaper(t: Source) -> DataFrame:
    return find_similar(t.product, t.product, t.grape, k=6, max_rank=3)


@add("find_similar_any_price", _similar(20, False))
def similar_any(t: Source) -> DataFrame:
    return find_similar(t.product, t.product, t.grape, k=20, cheaper_only=False, max_rank=3)


@add("upcoming_releases", f"""
SELECT {LISTED}, launch_date, sell_start_time, assortment_code, is_web_launch :: int :: bigint AS is_web_launch FROM {{noted}}
WHERE NOT is_discontinued AND substr(launch_date, 1, 10) BETWEEN '2026-08-25' AND '2026-09-08' AND upper(assortment_code) LIKE 'TS%'
  AND NOT is_web_launch AND cat1 = 'A' ORDER BY launch_date, price DESC NULLS LAST, product_id LIMIT 100
""")
def upcoming_releases(t: Source) -> DataFrame:
    return search.upcoming_releases(t.noted, AS_OF, limit=100, limited_only=True, web_launches="exclude", category="A").items


@add("nearest_release_days", """
SELECT substr(launch_date, 1, 10) AS launch_day, count(*) AS products FROM {product}
WHERE launch_date >= '2026-08-25' AND upper(assortment_code) LIKE 'TS%' GROUP BY 1 ORDER BY 1 LIMIT 5
""")
def nearest_release_days(t: Source) -> DataFrame:
    return search.nearest_release_days(t.product, AS_OF, limited_only=True)


@add("product_detail", """
SELECT p.product_id, p.product_number, p.price, p.assortment_code,
  array_to_string(g.grapes, '|') AS grapes, array_to_string(r.pairings, '|') AS pairings, array_to_string(c.carried_by, '|') AS carried_by
FROM {product} p
LEFT JOIN (SELECT product_id, list_sort(list(DISTINCT grape)) AS grapes FROM {grape} GROUP BY product_id) g USING (product_id)
LEFT JOIN (SELECT product_id, list_sort(list(DISTINCT pairing)) AS pairings FROM {pairing} GROUP BY product_id) r USING (product_id)
LEFT JOIN (SELECT product_id, list_sort(list(DISTINCT s.name || ' ' || cast(s.site_id AS string))) AS carried_by
  FROM {store_product} c JOIN {store} s ON s.site_id = c.site_id GROUP BY product_id) c USING (product_id)
WHERE p.availability_rank = 1
""")
def product_detail(t: Source) -> DataFrame:
    ids = t.product.filter(F.col("availability_rank") == 1)
    out = search.product_detail(t.catalogue(), ids, ("product_id", "product_number", "price", "assortment_code"))
    return out.withColumn("carried_by", F.transform(
        "carried_by", lambda s: F.concat_ws(" ", s["name"], s["site_id"].cast("string"))))


@add("list_stores", """
SELECT s.site_id, s.name, s.city, s.county, coalesce(n.n, 0) AS products, CASE WHEN n.n > 0 THEN 1 ELSE 0 END :: bigint AS mirrored
FROM {store} s LEFT JOIN (SELECT site_id, count(*) AS n FROM {store_product} GROUP BY site_id) n USING (site_id)
WHERE s.name ILIKE '%asia%' OR s.city ILIKE '%asia%' OR s.county ILIKE '%asia%'
""")
def list_stores(t: Source) -> DataFrame:
    return search.list_stores(t.store, t.store_product, "asia")


@add("mirrored_only_stores", """
SELECT s.site_id, s.name, count(*) AS products FROM {store} s JOIN {store_product} p USING (site_id) GROUP BY s.site_id, s.name
""")
def mirrored_only(t: Source) -> DataFrame:
    return search.list_stores(t.store, t.store_product, mirrored_only=True).select("site_id", "name", "products")


@add("latest_stock", """
WITH asked AS (SELECT DISTINCT site_id, product_id + 1 AS product_id FROM {store_product} WHERE product_id % 2 = 0
  UNION SELECT site_id, product_id FROM {store_product}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, product_id
  ORDER BY ts DESC, status DESC, stock DESC NULLS LAST) AS n FROM {readings}) r WHERE n = 1)
SELECT a.site_id, a.product_id, p.full_name, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS checked_at,
  CASE WHEN l.status = 404 THEN 0 WHEN l.status = 200 THEN coalesce(l.stock, 0) END :: bigint AS stock,
  CASE WHEN l.status = 503 THEN 'stock lookup failed with status 503' END AS error,
  CASE WHEN l.ts IS NULL THEN 0 ELSE 1 END :: bigint AS checked
FROM asked a LEFT JOIN latest l ON l.site_id = a.site_id AND l.product_id = a.product_id LEFT JOIN {product} p ON p.product_id = a.product_id
""")
def latest_stock(t: Source) -> DataFrame:
    rows = t.store_product
    near = rows.filter(F.col("product_id") % 2 == 0).select("site_id", (F.col("product_id") + 1).alias("product_id"))
    return search.latest_stock(t.readings, rows.select("site_id", "product_id").unionByName(near), t.product)


@add("carried_or_unknown", """
WITH asked AS (SELECT DISTINCT l_suppkey AS site_id, l_partkey + l_orderkey % 2 AS product_id FROM {lineitem}),
sites AS (SELECT DISTINCT site_id FROM {store_product})
SELECT a.site_id, a.product_id, CASE WHEN s.product_id IS NOT NULL THEN 1 WHEN m.site_id IS NULL THEN NULL
  WHEN substr(p.launch_date, 1, 10) > '2026-08-25' THEN NULL ELSE 0 END :: bigint AS carried
FROM asked a LEFT JOIN {store_product} s ON s.site_id = a.site_id AND s.product_id = a.product_id
LEFT JOIN sites m ON m.site_id = a.site_id LEFT JOIN {product} p ON p.product_id = a.product_id
""")
def carried_or_unknown(t: Source) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_suppkey").alias("site_id"), (F.col("l_partkey") + F.col("l_orderkey") % 2).alias("product_id")).distinct()
    return search.carried_or_unknown(pairs, t.store_product, t.product, SYNC)


# --- aggregates ---------------------------------------------------------------

@add("profile_by", """
SELECT country, count(*) AS n, round(avg(clock_tannin), 1) AS tannin, round(avg(clock_body), 1) AS body, round(avg(price), 0) AS avg_price
FROM {product} WHERE clock_tannin IS NOT NULL GROUP BY country HAVING count(*) >= 75
""")
def profile_by(t: Source) -> DataFrame:
    measures = {"tannin": ("clock_tannin", 1), "body": ("clock_body", 1), "avg_price": ("price", 0)}
    return aggregates.profile_by(t.product.filter(F.col("clock_tannin").isNotNull()), "country", measures, 75, "tannin")


@add("stats", """
SELECT (SELECT count(*) FROM {product}) AS products, (SELECT count(*) FROM {store}) AS stores,
  (SELECT count(DISTINCT grape) FROM {grape}) AS grapes
""")
def stats(t: Source) -> DataFrame:
    return aggregates.stats(t.product, t.store, t.grape)


@add("category_counts", """
SELECT cat1, count(*) AS products, count(*) FILTER (WHERE availability = 'stocked') AS stocked,
  count(*) FILTER (WHERE availability = 'order_only') AS order_only FROM {product} GROUP BY cat1
""")
def category_counts(t: Source) -> DataFrame:
    return aggregates.category_counts(t.product)


@add("freshness", """
SELECT count(*) AS products, strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') AS last_sync, count(DISTINCT cast(synced_at AS date)) AS sync_days,
  count(*) FILTER (WHERE substr(launch_date, 1, 10) > '2026-08-25') AS upcoming,
  max(substr(launch_date, 1, 10)) FILTER (WHERE substr(launch_date, 1, 10) > '2026-08-25') AS furthest FROM {product}
""")
def freshness(t: Source) -> DataFrame:
    return aggregates.freshness(t.product, AS_OF)


@add("mirrored_stores", """
SELECT s.site_id, s.name, count(*) AS products FROM {store_product} p JOIN {store} s ON s.site_id = p.site_id GROUP BY s.site_id, s.name
""")
def mirrored_stores(t: Source) -> DataFrame:
    return aggregates.mirrored_stores(t.store, t.store_product)


@add("completeness_by_tier", """
SELECT availability, count(*) AS n, round(avg(CASE WHEN taste IS NOT NULL THEN 1 ELSE 0 END), 4) AS share FROM {noted} GROUP BY availability
""")
def completeness_by_tier(t: Source) -> DataFrame:
    return aggregates.share_present(t.noted, "availability", "taste")


@add("list_agg", """
SELECT product_id, string_agg(grape, ', ' ORDER BY grape) AS grapes FROM {grape} GROUP BY product_id
""")
def list_agg(t: Source) -> DataFrame:
    return aggregates.list_agg(t.grape, "product_id", "grape", out="grapes")


@add("weekday_histogram", """
SELECT dayname(cast(substr(launch_date, 1, 10) AS date)) AS weekday, count(*) AS n FROM {product} WHERE assortment_text = 'temporary' GROUP BY 1
""")
def weekday_histogram(t: Source) -> DataFrame:
    rows = t.product.filter(F.col("assortment_text") == "temporary")
    return aggregates.weekday_histogram(rows, search.launch_day())


@add("collapse_editions", """
SELECT full_name, producer, count(*) AS editions, min(sek_per_litre) AS best_sek_per_litre,
  array_to_string(list_sort(list(DISTINCT vintage) FILTER (WHERE vintage IS NOT NULL)), '|') AS vintages
FROM {product} GROUP BY full_name, producer
""")
def collapse_editions(t: Source) -> DataFrame:
    out = aggregates.collapse_editions(t.product)
    return out.withColumn("vintages", F.when(F.size("vintages") > 0, F.col("vintages")))


@add("arg_extreme", """
SELECT * FROM (SELECT 'country with most' AS question, country AS answer, count(*) :: double AS value FROM {product}
  WHERE product_id IN (SELECT product_id FROM {grape} WHERE grape = 'gear') AND product_id NOT IN (SELECT product_id FROM {grape} WHERE grape = 'red')
  GROUP BY country ORDER BY value DESC, answer LIMIT 1) a
UNION ALL SELECT * FROM (SELECT 'store with fewest', s.name, count(*) :: double FROM {store_product} p JOIN {store} s ON s.site_id = p.site_id
  GROUP BY s.name ORDER BY 3, 2 LIMIT 1) b
UNION ALL SELECT * FROM (SELECT 'dearest web launch', producer, max(price) FROM {product} WHERE is_web_launch GROUP BY producer
  ORDER BY 3 DESC NULLS LAST, 2 LIMIT 1) c
""")
def arg_extreme(t: Source) -> DataFrame:
    gear = filters.having_not(filters.having(t.product, t.grape, "product_id", "grape", "gear"), t.grape, "product_id", "grape", "red")
    named = t.store_product.join(t.store.select("site_id", "name"), "site_id")
    parts = [
        ("country with most", aggregates.arg_extreme(gear, "country", F.count(F.lit(1))), "country"),
        ("store with fewest", aggregates.arg_extreme(named, "name", F.count(F.lit(1)), most=False), "name"),
        ("dearest web launch", aggregates.arg_extreme(t.product.filter("is_web_launch"), "producer", F.max("price")), "producer"),
    ]
    out = None
    for question, df, key in parts:
        row = df.select(F.lit(question).alias("question"), F.col(key).alias("answer"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@add("codes_by_label", """
SELECT assortment_code, assortment_text, count(*) AS n FROM {product} WHERE upper(assortment_code) LIKE 'TS%' GROUP BY 1, 2
""")
def codes_by_label(t: Source) -> DataFrame:
    rows = t.product.filter(search.limited_release())
    return rows.groupBy("assortment_code", "assortment_text").agg(F.count(F.lit(1)).alias("n"))


# --- order and paging ---------------------------------------------------------

def _sorted(name: str, mode: str, order: str) -> None:
    @add(name, f"""
SELECT product_id, full_name, price, sek_per_litre, clock_body :: bigint AS clock_body, row_number() OVER (ORDER BY {order}, product_id) AS rank FROM {{product}}
""")
    def plan(t: Source) -> DataFrame:
        ranked = search.with_rank(t.product, search.sort_order(mode))
        return ranked.select("product_id", "full_name", "price", "sek_per_litre", "clock_body", "rank")


_sorted("sort_price_asc", "price_asc", "price NULLS FIRST")
_sorted("sort_price_desc", "price_desc", "price DESC NULLS LAST")
_sorted("sort_value", "value", "sek_per_litre NULLS FIRST")
_sorted("sort_body", "body_desc", "clock_body DESC NULLS LAST, price NULLS FIRST")
_sorted("sort_name", "name", "full_name NULLS FIRST")


@add("page_items", "SELECT product_id, price FROM {product} ORDER BY price NULLS FIRST, product_id LIMIT 25 OFFSET 75")
def page_items(t: Source) -> DataFrame:
    return search.page(t.product.select("product_id", "price"), search.sort_order("price_asc"), 25, 75).items


@add("page_meta", """
SELECT count(*) AS total, 25 :: bigint AS count, 75 :: bigint AS offset, 1 :: bigint AS has_more, 100 :: bigint AS next_offset FROM {product}
""")
def page_meta(t: Source) -> DataFrame:
    return search.page(t.product.select("product_id", "price"), search.sort_order("price_asc"), 25, 75).meta


@add("best_value", f"""
SELECT product_id, full_name, price, volume_ml, round(sek_per_litre) AS sek_per_l FROM {{product}}
WHERE {SHELF} AND cat1 = 'A' AND clock_body >= 7 AND clock_tannin >= 5 AND sek_per_litre IS NOT NULL
ORDER BY sek_per_litre, product_id LIMIT 10
""")
def best_value(t: Source) -> DataFrame:
    profile = filters.clock_range(filters.common_filters(t.product, 1, "A"), min_body=7, min_tannin=5)
    return search.best_value(profile, 10).select("product_id", "full_name", "price", "volume_ml",
                                                 F.round("sek_per_litre").alias("sek_per_l"))


@add("adhoc_sql", """
SELECT country, availability, count(*) AS n, round(avg(price), 1) AS avg_price FROM {product}
WHERE country < 'NATION_2' GROUP BY country, availability HAVING count(*) > 5
""")
def adhoc_sql(t: Source) -> DataFrame:
    return sqlapi.query(t.spark, """
      SELECT country, availability, count(*) AS n, round(avg(price), 1) AS avg_price FROM {product}
      WHERE country < 'NATION_2' GROUP BY country, availability HAVING count(*) > 5""", {"product": t.product})
