"""The test tables seen as a catalogue, its mirror runs and its cellars.

Each view is one SELECT that Spark and any ANSI engine read alike, so the same
text feeds the operators here and the checks elsewhere. Names in braces are
other views or tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

PRODUCT = """
SELECT b.*,
  CASE WHEN volume_ml > 0 THEN price / (volume_ml / cast(1000 AS double)) END AS sek_per_litre
FROM (
  SELECT p_partkey AS product_id,
    cast(1000000 + p_partkey AS string) AS product_number,
    p_name AS name, p_name AS full_name, p_brand AS producer,
    'NATION_' || cast(p_partkey % 25 AS string) AS country,
    'O' || cast(p_partkey % 9 AS string) AS origin1,
    CASE WHEN p_partkey % 2 = 0 THEN 'Q' || cast(p_partkey % 7 AS string) END AS origin2,
    CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'A' ELSE 'B' END AS cat1,
    CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS cat2,
    cast(NULL AS string) AS cat3,
    CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_retailprice END AS price,
    CASE WHEN p_partkey % 11 = 0 THEN cast(0 AS double) ELSE cast(p_size AS double) * 25 END AS volume_ml,
    CASE WHEN p_partkey % 13 = 0 THEN cast(0 AS double) ELSE cast(p_partkey % 15 AS double) END AS abv,
    cast(p_partkey % 8 AS double) / 4 AS sugar_g_per_100ml,
    CASE WHEN p_partkey % 23 = 0 THEN 'order_only' WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'stocked'
         WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'limited' ELSE 'order_only' END AS availability,
    CASE WHEN p_partkey % 23 = 0 THEN 3 WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 1
         WHEN p_type IN ('SMALL', 'MEDIUM') THEN 2 ELSE 3 END AS availability_rank,
    p_partkey % 31 = 0 AS is_discontinued,
    p_partkey % 3 = 0 AS is_organic,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 4 = 1 END AS is_vegan,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 0 ELSE cast(p_size % 13 AS int) END AS clock_body,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 0 ELSE cast(p_partkey % 13 AS int) END AS clock_tannin,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 0 ELSE cast((p_partkey * 7) % 13 AS int) END AS clock_sweetness,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 0 ELSE cast((p_partkey * 5) % 13 AS int) END AS clock_fruitacid,
    cast((p_partkey * 3) % 13 AS int) AS clock_bitter,
    cast((p_size * 2) % 13 AS int) AS clock_smokiness,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(1990 + p_size % 30 AS int) END AS vintage,
    cast(cast(date_add(date '2026-08-01', cast(p_partkey % 60 AS int)) AS date) AS string) || 'T00:00:00' AS launch_date,
    '10:00:00' AS sell_start_time,
    CASE p_partkey % 5 WHEN 0 THEN 'TSE' WHEN 1 THEN 'FS' WHEN 2 THEN 'tsls' WHEN 3 THEN 'TSV' END AS assortment_code,
    CASE p_partkey % 5 WHEN 0 THEN 'temporary' WHEN 1 THEN 'fixed' WHEN 2 THEN 'local' WHEN 3 THEN 'temporary' END AS assortment_text,
    p_partkey % 6 = 0 AS is_web_launch,
    CASE WHEN p_partkey % 50 = 0 THEN timestamp '2026-08-20 06:00:00' ELSE timestamp '2026-08-25 06:00:00' END AS synced_at
  FROM {part}
) b
"""

def _slot_list(seq: str, count: str) -> str:
    """SQL for up to seven neighbouring slots as one location; every 31st names one slot again and again."""
    slot = lambda i: (f"chr(cast(65 + ({seq} + CASE WHEN {seq} % 31 = 0 THEN 0 ELSE {i} END) % 13 AS int)) "  # noqa: E731
                      f"|| cast(1 + cast(floor({seq} / 13) AS bigint) % 13 AS string)")
    return slot(0) + "".join(f" || CASE WHEN {count} > {i} THEN ', ' || {slot(i)} ELSE '' END" for i in range(1, 7))


VIEWS = {
    "product": PRODUCT,
    # The catalogue with its tasting notes; about half the products have one.
    "noted": """
SELECT p.*, d.text AS taste, d.lang AS color, d.source AS usage
FROM {product} p LEFT JOIN {documents} d ON d.doc_id = p.product_id
""",
    "raw_grape": """
SELECT p_partkey AS product_id, 0 AS pos, split_part(p_name, ' ', 1) AS raw_name FROM {part}
UNION ALL
SELECT p_partkey AS product_id, 1 AS pos, split_part(p_name, ' ', 2) AS raw_name FROM {part}
""",
    "grape": """
SELECT product_id, grape, max_by(raw_name, pos) AS raw_name
FROM (SELECT product_id, pos, raw_name,
        CASE raw_name WHEN 'bolt' THEN 'rod' WHEN 'hot' THEN 'gear' ELSE raw_name END AS grape
      FROM {raw_grape}) g
GROUP BY product_id, grape
""",
    "pairing": """
SELECT DISTINCT l_partkey AS product_id, 'P' || cast(l_orderkey % 40 AS string) AS pairing FROM {lineitem}
""",
    "store": """
SELECT s_suppkey AS site_id, s_name AS name, 'Street ' || cast(s_suppkey AS string) AS address,
  n_name AS city, r_name AS county
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
""",
    "store_product": """
SELECT DISTINCT l_suppkey AS site_id, l_partkey AS product_id, timestamp '2026-08-25 06:00:00' AS synced_at
FROM {lineitem} WHERE l_suppkey % 10 <> 0
""",
    "walks": """
SELECT l_suppkey AS slice, l_linenumber AS pass, l_orderkey AS pos, l_partkey AS product_id FROM {lineitem}
""",
    # What each walk should have found: the truth, one more for every seventh
    # slice, less for every fifth, nothing for every eleventh.
    "expected": """
SELECT slice, CASE WHEN slice % 11 = 0 THEN 0 WHEN slice % 7 = 0 THEN n + 1 WHEN slice % 5 = 0 THEN n - n % 40 - 1
    ELSE n END AS expected
FROM (SELECT l_suppkey AS slice, count(DISTINCT l_partkey) AS n FROM {lineitem} GROUP BY l_suppkey) e
""",
    "readings": """
SELECT l_suppkey AS site_id, l_partkey AS product_id, l_shipdate AS ts,
  cast(CASE WHEN l_orderkey % 20 = 0 THEN 404 WHEN l_orderkey % 20 = 1 THEN 503 ELSE 200 END AS int) AS status,
  CASE WHEN l_orderkey % 20 = 2 THEN NULL ELSE cast(l_quantity AS int) END AS stock
FROM {lineitem}
""",
    "snapshot_b": """
SELECT product_id,
  CASE WHEN product_id % 10 = 0 THEN price * cast(1.1 AS double) ELSE price END AS price,
  CASE WHEN product_id % 7 = 0 THEN vintage + 1 ELSE vintage END AS vintage
FROM {product} WHERE product_id % 17 <> 0
UNION ALL
SELECT product_id + 1000000000 AS product_id, price, vintage FROM {product} WHERE product_id % 20 = 3
""",
    "event": """
SELECT 'C' || cast(user_id % 25 AS string) AS cellar_id, user_id AS wine_id, event_id,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'adjusted' WHEN 'view' THEN 'adjusted' ELSE 'removed' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'drunk' WHEN 'click' THEN 'gift' END AS reason,
  cast(CASE event_type WHEN 'signup' THEN 1 + event_id % 3 WHEN 'error' THEN event_id % 3 - 1 WHEN 'view' THEN 0
    ELSE -1 END AS int) AS quantity,
  cast(ts AS date) AS on_date,
  cast(CASE WHEN event_type = 'view' THEN 1 + event_id % 5 END AS int) AS rating,
  CASE WHEN event_id % 4 = 0 THEN 'note ' || cast(event_id AS string) END AS note
FROM {events}
""",
    "wine": """
SELECT 'C' || cast(c_custkey % 25 AS string) AS cellar_id, c_custkey AS wine_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS product_id,
  'Wine ' || cast(c_custkey % 97 AS string) AS name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'House ' || cast(c_custkey % 13 AS string) END AS producer,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE cast(1990 + c_custkey % 30 AS int) END AS vintage,
  'Land ' || cast(c_nationkey AS string) AS country,
  cast(NULL AS string) AS region,
  c_mktsegment AS category,
  cast(NULL AS string) AS grapes, cast(750 AS int) AS volume_ml,
  cast(c_custkey % 6 AS int) AS quantity,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS purchase_price,
  CASE c_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'SEK' END AS purchase_currency,
  CASE c_custkey % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2024-03' WHEN 2 THEN '2024-13' ELSE '2024-03-31' END AS purchased_on,
  cast(NULL AS string) AS purchased_from,
  CASE WHEN c_custkey % 5 = 0 THEN 'fridge' WHEN c_custkey % 5 = 1 OR c_custkey % 6 = 0 THEN NULL
    ELSE chr(cast(65 + j % 12 AS int)) || cast(1 + j % 14 AS string)
      || CASE WHEN c_custkey % 6 > 1 THEN ', ' || lower(chr(cast(65 + (j + 1) % 12 AS int))) || cast(1 + j % 14 AS string) ELSE '' END
      || CASE WHEN c_custkey % 6 > 2 THEN ',' || chr(cast(65 + (j + 2) % 12 AS int)) || cast(1 + j % 14 AS string) ELSE '' END
      || CASE WHEN c_custkey % 6 > 3 THEN ' , cellar floor' ELSE '' END
    END AS location,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE cast(2020 + c_custkey % 12 AS int) END AS drink_from,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast(2022 + c_custkey % 10 AS int) END AS drink_until,
  CASE WHEN c_custkey % 9 = 0 THEN 'from ' || c_name END AS notes,
  CASE WHEN c_custkey % 3 = 0 THEN 'taste ' || cast(c_custkey AS string) END AS sb_taste,
  cast(c_custkey % 4 AS int) AS clock_body, cast(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 3 END AS int) AS clock_tannin,
  cast(CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE 1 END AS int) AS clock_sweetness,
  cast(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 6 END AS int) AS clock_fruitacid,
  cast(NULL AS double) AS abv,
  CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey % 60 AS double) END AS sugar_g_l,
  cast(NULL AS string) AS style, cast(NULL AS int) AS base_vintage,
  cast(NULL AS string) AS disgorged_on,
  CASE WHEN c_custkey % 10 = 3 THEN 'profile' END AS profile,
  CASE WHEN c_custkey % 20 = 3 THEN 'source' END AS profile_sources,
  cast(NULL AS string) AS profiled_on,
  CASE WHEN c_custkey % 15 = 1 THEN '2026-01-01' END AS reviews_checked_on,
  timestamp '2026-01-01 00:00:00' AS added_at, timestamp '2026-01-01 00:00:00' AS updated_at
FROM (SELECT c.*, cast(floor(c_custkey / 25) AS bigint) AS j FROM {customer} c) c
""",
    "review": """
SELECT 'C' || cast(o_custkey % 25 AS string) AS cellar_id, o_orderkey AS review_id, o_custkey AS wine_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Critic ' ELSE 'CRITIC ' END || cast(o_orderkey % 4 AS string) AS critic,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 100 AS double) END AS score,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN cast(20 AS double) ELSE cast(100 AS double) END AS scale,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Gold' END AS award,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(cast(o_orderdate AS string), 1, 4)
    ELSE substr(cast(o_orderdate AS string), 1, 10) END AS tasted_on,
  CASE o_orderkey % 3 WHEN 0 THEN 'this_release' WHEN 1 THEN 'other_release' ELSE 'unknown' END AS release,
  cast(NULL AS string) AS release_note,
  cast(2020 + o_orderkey % 9 AS int) AS drink_from, cast(2021 + o_orderkey % 11 AS int) AS drink_until,
  CASE WHEN o_orderkey % 4 = 1 THEN 'summary' END AS summary,
  cast(NULL AS string) AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN 'at_source' ELSE 'quoted' END AS seen,
  '2026-01-01' AS recorded_on
FROM {orders}
""",
    # One rack pair per cellar: A-H and I-L, with two positions missing.
    "rack": """
SELECT DISTINCT 'C' || cast(c_custkey % 25 AS string) AS cellar_id, cast(r AS int) AS rack_no,
  CASE WHEN r = 1 THEN 'A' ELSE 'I' END AS col_from, CASE WHEN r = 1 THEN 'H' ELSE 'L' END AS col_to,
  cast(1 AS int) AS row_from, cast(CASE WHEN r = 1 THEN 13 ELSE 14 END AS int) AS row_to,
  CASE WHEN r = 1 THEN 'D12,D13' ELSE '' END AS gaps
FROM {customer} JOIN (SELECT 1 AS r UNION ALL SELECT 2 AS r) n ON r > 0
WHERE c_custkey % 25 < 20
""",
    # Adds and patches that claim slots of the racks: free and held ones, outside, twice, too few.
    "placed_add": f"""
SELECT 'C' || cast(o_custkey % 25 AS string) AS cellar_id, o_orderkey AS seq, o_custkey AS key,
  o_orderkey % 3 = 0 AS named, cast(1 + o_orderkey % 2 AS int) AS quantity, o_orderkey % 5 <> 0 AS moves,
  CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_orderkey % 5 = 1 THEN 'shelf' END ELSE {_slot_list(
    "o_orderkey", "1 + o_orderkey % 2 + CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR o_custkey % 4 = 0 THEN 0 ELSE o_custkey % 6 END")} END AS location
FROM {{orders}}
""",
    "placed_patch": f"""
SELECT 'C' || cast(user_id % 25 AS string) AS cellar_id, user_id AS wine_id, event_id AS seq,
  cast(CASE WHEN event_id % 5 = 0 THEN event_id % 6 END AS int) AS quantity, event_id % 3 <> 1 AS moves,
  CASE WHEN event_id % 3 = 1 OR event_id % 14 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'cupboard' ELSE {_slot_list(
    "event_id", "CASE WHEN event_id % 5 = 0 THEN event_id % 6 ELSE user_id % 6 END + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END")} END AS location
FROM {{events}}
""",
    # Bottles taken out, as commands in the order of their events.
    "removal": """
SELECT 'C' || cast(user_id % 25 AS string) AS cellar_id, user_id AS wine_id, event_id AS seq,
  cast(1 + event_id % 4 AS int) AS quantity,
  CASE event_type WHEN 'purchase' THEN 'drunk' WHEN 'click' THEN 'gift' ELSE 'sold' END AS reason,
  cast(ts AS date) AS on_date,
  cast(CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 5 END AS int) AS rating
FROM {events} WHERE event_type <> 'error'
""",
    # Two days of raw records whose lists change: a product of the second day may list less, or nothing.
    "raw_lists": """
SELECT p_partkey AS product_key, d AS day_no,
  replace(replace('<"productId": "' || cast(p_partkey AS string) || '", "grapes": ['
    || CASE WHEN d = 1 THEN '"G' || cast(p_partkey % 7 AS string) || '", " g' || cast(p_partkey % 5 AS string) || '  ", " ", 7'
        WHEN p_partkey % 4 = 0 THEN '' ELSE '"G' || cast(p_partkey % 3 AS string) || '"' END
    || '], "tasteSymbols": ['
    || CASE WHEN d = 1 THEN '"P' || cast(p_partkey % 3 AS string) || '", "P' || cast(p_partkey % 4 AS string) || '"'
        WHEN p_partkey % 5 = 0 THEN '' ELSE '"P' || cast(p_partkey % 2 AS string) || '"' END || ']>', '<', chr(123)), '>', chr(125)) AS raw
FROM {part} JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d) n ON d = 1 OR p_partkey % 3 <> 1
""",
    # Raw product records with fields that are sometimes mistyped or missing.
    "raw_product": """
SELECT p_partkey AS product_key,
  '[' || CASE WHEN p_partkey % 4 = 1 THEN cast(p_partkey AS string) ELSE '"' || cast(p_partkey AS string) || '"' END
  || ']' AS list_json,
  replace(replace('<"productId": "' || cast(p_partkey AS string) || '", "productNameBold": '
    || CASE p_partkey % 4 WHEN 0 THEN '42' WHEN 1 THEN 'null' ELSE '"  ' || p_name || ' "' END
    || ', "productNameThin": "' || p_brand || '", "price": '
    || CASE p_partkey % 4 WHEN 0 THEN '"not a number"' WHEN 1 THEN '"' || cast(p_size AS string) || '.5"'
        WHEN 2 THEN cast(p_size AS string) || '.25' ELSE '" 12"' END
    || ', "volume": ' || cast(p_size * 25 AS string)
    || ', "vintage": ' || CASE p_partkey % 3 WHEN 0 THEN '" ' || cast(1990 + p_size AS string) || '"'
        WHEN 1 THEN cast(1990 + p_size AS string) || '.9' ELSE '"19x"' END
    || ', "isOrganic": ' || CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END
    || ', "tasteClockBody": ' || CASE WHEN p_partkey % 2 = 0 THEN cast(p_size % 13 AS string) || '.9' ELSE '"-3.7"' END
    || ', "country": "' || CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'Land' END
    || '", "assortmentText": "' || CASE p_partkey % 4 WHEN 0 THEN 'Fast sortiment' WHEN 1 THEN ' Ordervaror '
        WHEN 2 THEN 'Presentsortiment' ELSE 'Something New' END || '">', '<', chr(123)), '>', chr(125)) AS raw
FROM {part}
""",
}


def _names(text: str) -> list[str]:
    return re.findall(r"(?<!\\p)\{(\w+)\}", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a view over them as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_names(text))})


def with_views(sql: str) -> str:
    """``sql`` as one statement, the views it names in braces put in front as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for inner in _names(VIEWS[name]):
            visit(inner)
        order.append(name)

    for name in _names(sql):
        visit(name)
    def plain(text: str) -> str:
        return re.sub(r"(?<!\\p)\{(\w+)\}", r"\1", text)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"
