"""Queries of the cellars: ledger, windows, racks, command batches, reviews."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shelfwise import spec
from shelfwise.functions import cellar as rules
from shelfwise.operators import commands, ledger, rack, reviews
from shelfwise.operators.search import with_rank
from shelfwise.plans.catalogue import LISTING
from shelfwise.plans.registry import Registry, Source

registry = Registry()
add = registry.add

TODAY = date(2026, 9, 1)
YEAR = 2026


def _racks(t: Source) -> DataFrame:
    return t.rack.select("cellar_id", "rack_no", "col_from", "col_to", "row_from", "row_to",
                         F.filter(F.split("gaps", ","), lambda g: g != "").alias("missing"))


# --- ledger -------------------------------------------------------------------

@add("ledger_balance", """
SELECT w.cellar_id, w.wine_id, coalesce(e.quantity, 0) :: bigint AS quantity FROM {wine} w
LEFT JOIN (SELECT cellar_id, wine_id, sum(quantity) AS quantity FROM {event} GROUP BY cellar_id, wine_id) e USING (cellar_id, wine_id)
""")
def ledger_balance(t: Source) -> DataFrame:
    return ledger.ledger_balance(t.event, t.wine)


SUMMARY = """SELECT cellar_id, wine_id, round(avg(rating), 1) AS avg_rating,
  -coalesce(sum(quantity) FILTER (WHERE kind = 'removed' AND reason = 'drunk'), 0) :: bigint AS times_drunk,
  max_by(note, struct_pack(d := on_date, i := event_id)) FILTER (WHERE note IS NOT NULL) AS last_note
FROM {event} GROUP BY cellar_id, wine_id"""


@add("ledger_summary", SUMMARY)
def ledger_summary(t: Source) -> DataFrame:
    return ledger.ledger_summary(t.event)


@add("drink_windows", f"""
SELECT cellar_id, wine_id,
  CASE WHEN (drink_from IS NOT NULL OR drink_until IS NOT NULL) AND coalesce(drink_from, 0) <= {YEAR} AND coalesce(drink_until, 9999) >= {YEAR} THEN 1 ELSE 0 END :: bigint AS ready,
  CASE WHEN drink_until IS NOT NULL AND drink_until <= {YEAR + 1} THEN 1 ELSE 0 END :: bigint AS drink_soon,
  CASE WHEN drink_from > {YEAR} THEN 1 ELSE 0 END :: bigint AS not_yet,
  CASE WHEN drink_from IS NULL AND drink_until IS NULL THEN 1 ELSE 0 END :: bigint AS unknown
FROM {{wine}}
""")
def drink_windows(t: Source) -> DataFrame:
    return ledger.with_windows(t.wine, YEAR).select("cellar_id", "wine_id", *spec.DRINK_WINDOWS)


@add("window_state", f"""
SELECT cellar_id, wine_id, CASE WHEN drink_from IS NULL AND drink_until IS NULL THEN NULL WHEN drink_until < {YEAR} THEN 'past its window'
  WHEN drink_from > {YEAR} THEN 'not ready yet' WHEN drink_until <= {YEAR + 1} THEN 'ready, drink soon' ELSE 'ready' END AS window_state
FROM {{wine}}
""")
def window_state(t: Source) -> DataFrame:
    return ledger.with_windows(t.wine, YEAR).select("cellar_id", "wine_id", "window_state")


@add("list_cellar", f"""
SELECT w.cellar_id, w.wine_id, w.name, s.avg_rating, coalesce(s.times_drunk, 0) AS times_drunk, s.last_note
FROM {{wine}} w JOIN ({SUMMARY}) s USING (cellar_id, wine_id)
WHERE w.quantity > 0 AND (w.name ILIKE '%2%' OR w.producer ILIKE '%2%' OR w.country ILIKE '%2%' OR w.notes ILIKE '%2%')
  AND s.avg_rating >= 2.5 AND w.drink_until <= {YEAR + 1}
""")
def list_cellar(t: Source) -> DataFrame:
    listed = ledger.list_cellar(t.wine, t.event, year=YEAR, search="2", min_rating=2.5, drink_window="drink_soon")
    return ledger.sort_cellar(listed, "rating").select("cellar_id", "wine_id", "name", "avg_rating", "times_drunk", "last_note")


@add("cellar_queues", """
SELECT 'profile' AS queue, cellar_id, wine_id FROM {wine} WHERE quantity > 0 AND lower(category) = 'building' AND sb_taste IS NULL AND profile IS NULL
UNION ALL SELECT 'reviews', cellar_id, wine_id FROM {wine} w WHERE reviews_checked_on IS NULL
  AND NOT EXISTS (SELECT 1 FROM {review} r WHERE r.cellar_id = w.cellar_id AND r.wine_id = w.wine_id AND r.score > 90)
""")
def cellar_queues(t: Source) -> DataFrame:
    profile = ledger.list_cellar(t.wine, t.event, category="Building", needs_profile=True)
    unseen = ledger.list_cellar(t.wine, t.event, t.review.filter(F.col("score") > 90), needs_reviews=True, include_empty=True)
    return profile.select(F.lit("profile").alias("queue"), "cellar_id", "wine_id").unionByName(
        unseen.select(F.lit("reviews").alias("queue"), "cellar_id", "wine_id"))


SORTS = {"drink_until": "drink_until NULLS LAST, drink_from NULLS LAST, name", "name": "lower(name), vintage NULLS FIRST",
         "vintage": "vintage NULLS LAST, name", "added": "added_at DESC"}


@add("cellar_sorts", " UNION ALL ".join(
    f"SELECT '{mode}' AS sort, cellar_id, wine_id, row_number() OVER (ORDER BY {order}, cellar_id, wine_id) AS rank FROM {{wine}}" for mode, order in SORTS.items()))
def cellar_sorts(t: Source) -> DataFrame:
    out = None
    for mode in SORTS:
        listed = with_rank(ledger.list_cellar(t.wine, t.event, include_empty=True), ledger.cellar_order(mode))
        rows = listed.select(F.lit(mode).alias("sort"), "cellar_id", "wine_id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


@add("current_listing", LISTING)
def current_listing(t: Source) -> DataFrame:
    return ledger.current_listing(t.wine, t.product).select(
        "cellar_id", "wine_id", "listed_vintage", "listed_price", "listed_availability", "same_vintage")


@add("cellar_summary", """
SELECT cellar_id, count(*) AS wines, sum(quantity) :: bigint AS bottles FROM {wine} WHERE quantity > 0 GROUP BY cellar_id
""")
def cellar_summary(t: Source) -> DataFrame:
    return ledger.summary(t.wine)


@add("paid_by_currency", """
SELECT cellar_id, coalesce(purchase_currency, 'SEK') AS currency, round(sum(quantity * purchase_price), 2) AS total
FROM {wine} WHERE quantity > 0 AND purchase_price IS NOT NULL GROUP BY 1, 2
""")
def paid_by_currency(t: Source) -> DataFrame:
    return ledger.paid_by_currency(t.wine)


@add("history", """
SELECT cellar_id, wine_id, event_id, kind, on_date, CASE WHEN quantity > 0 THEN '+' ELSE '' END || cast(quantity AS string) AS change FROM {event}
""")
def history(t: Source) -> DataFrame:
    return ledger.history(t.event, t.wine).select("cellar_id", "wine_id", "event_id", "kind", "on_date", "change")


@add("profile_violations", """
SELECT cellar_id, wine_id, 'profile without sources' AS rule FROM {wine} WHERE profile <> '' AND coalesce(profile_sources, '') = ''
UNION ALL SELECT cellar_id, wine_id, 'invalid purchase date' FROM {wine} WHERE purchased_on = '2024-13'
UNION ALL SELECT cellar_id, wine_id, 'window runs backwards' FROM {wine} WHERE drink_from > drink_until
""")
def profile_violations(t: Source) -> DataFrame:
    return ledger.profile_violations(t.wine)


@add("clear_unrated_clocks", """
SELECT wine_id, CASE WHEN wine_id % 8 <> 0 THEN clock_body END :: bigint AS clock_body,
  CASE WHEN wine_id % 8 <> 0 THEN clock_sweetness END :: bigint AS clock_sweetness FROM {wine}
""")
def clear_unrated_clocks(t: Source) -> DataFrame:
    return ledger.clear_unrated_clocks(t.wine).select("wine_id", "clock_body", "clock_sweetness")


# --- racks --------------------------------------------------------------------

GRID = """
grid AS (SELECT r.cellar_id, chr(cast(c.c AS int)) || cast(n.n AS string) AS slot
  FROM {rack} r JOIN (SELECT unnest(range(65, 91)) AS c) c ON c.c BETWEEN ascii(r.col_from) AND ascii(r.col_to)
  JOIN (SELECT unnest(range(1, 100)) AS n) n ON n.n BETWEEN r.row_from AND r.row_to
  WHERE NOT list_contains(split(r.gaps, ','), chr(cast(c.c AS int)) || cast(n.n AS string))),
parts AS (SELECT cellar_id, wine_id, quantity, CASE WHEN regexp_matches(upper(p), '^[A-Z]\\d{1,3}$') THEN upper(p) ELSE p END AS part
  FROM (SELECT cellar_id, wine_id, quantity, trim(unnest(split(location, ','))) AS p FROM {wine} WHERE location IS NOT NULL) x WHERE p <> ''),
held AS (SELECT cellar_id, wine_id, part AS slot, count(*) AS times FROM parts
  WHERE quantity > 0 AND regexp_matches(part, '^[A-Z]\\d{1,3}$') GROUP BY 1, 2, 3)
"""


@add("slots", f"WITH {GRID} SELECT cellar_id, slot FROM grid")
def slots(t: Source) -> DataFrame:
    return rack.slots(_racks(t)).select("cellar_id", "slot")


@add("free_slots", f"""
WITH {GRID} SELECT cellar_id, slot FROM grid g WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.cellar_id = g.cellar_id AND h.slot = g.slot)
""")
def free_slots(t: Source) -> DataFrame:
    return rack.free_slots(_racks(t), t.wine).select("cellar_id", "slot")


@add("slot_map", f"""
WITH {GRID} SELECT g.cellar_id, g.slot, max(h.wine_id) AS wine_id FROM grid g
LEFT JOIN held h ON h.cellar_id = g.cellar_id AND h.slot = g.slot GROUP BY g.cellar_id, g.slot
""")
def slot_map(t: Source) -> DataFrame:
    return rack.slot_map(_racks(t), t.wine).select("cellar_id", "slot", "wine_id")


@add("bottles_elsewhere", f"""
WITH {GRID} SELECT cellar_id, wine_id, '#' || cast(wine_id AS string) || ' ' || coalesce(producer || ' ', '') || name || ' ' || coalesce(cast(vintage AS string), 'NV') AS label,
  quantity :: bigint AS quantity, location FROM {{wine}} w WHERE quantity > 0
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.cellar_id = w.cellar_id AND h.wine_id = w.wine_id)
""")
def bottles_elsewhere(t: Source) -> DataFrame:
    return rack.elsewhere(t.wine)


@add("location_parts", f"WITH {GRID} SELECT cellar_id, wine_id, string_agg(part, '|' ORDER BY part) AS parts FROM parts GROUP BY 1, 2")
def location_parts(t: Source) -> DataFrame:
    out = t.wine.filter(F.col("location").isNotNull())
    return out.select("cellar_id", "wine_id", F.array_sort(rules.location_parts(F.col("location"))).alias("parts"))


@add("placement_violations", f"""
WITH {GRID}, mine AS (SELECT h.* FROM held h WHERE h.cellar_id IN (SELECT cellar_id FROM {{rack}}))
SELECT p.cellar_id, p.wine_id, 'places differ from bottles' AS rule, NULL :: string AS slot, NULL :: bigint AS other_wine
FROM (SELECT cellar_id, wine_id, quantity, count(*) AS n FROM parts GROUP BY 1, 2, 3) p
WHERE p.n <> p.quantity AND EXISTS (SELECT 1 FROM mine m WHERE m.cellar_id = p.cellar_id AND m.wine_id = p.wine_id)
UNION ALL SELECT cellar_id, wine_id, 'listed twice', slot, NULL FROM mine WHERE times > 1
UNION ALL SELECT cellar_id, wine_id, 'outside the rack', slot, NULL FROM mine m
  WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.cellar_id = m.cellar_id AND g.slot = m.slot)
UNION ALL SELECT cellar_id, wine_id, 'held by another wine', slot, CASE WHEN wine_id = low THEN high ELSE low END
  FROM (SELECT *, min(wine_id) OVER w AS low, max(wine_id) OVER w AS high FROM mine WINDOW w AS (PARTITION BY cellar_id, slot)) m WHERE low < high
""")
def placement_violations(t: Source) -> DataFrame:
    return rack.placement_violations(_racks(t), t.wine)


# --- commands -----------------------------------------------------------------

def _adds(t: Source) -> DataFrame:
    """One add per order: by id, by number, by both, or by name."""
    key, kind = F.col("o_custkey"), F.col("o_orderkey") % 5
    number = (F.lit(1000000) + key).cast("string")
    fields = F.map_filter(F.create_map(
        F.lit("name"), F.when(kind == 4, F.concat(F.lit("Own "), key.cast("string"))),
        F.lit("vintage"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("2001")),
        F.lit("location"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("shelf "), F.col("o_orderkey").cast("string"))),
        F.lit("purchase_currency"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(" eur ")),
    ), lambda k, v: v.isNotNull() | ((k == "vintage") & (F.col("o_orderkey") % 11 == 0)))
    return t.orders.select(
        F.concat(F.lit("C"), (key % 25).cast("string")).alias("cellar_id"), F.col("o_orderkey").alias("seq"),
        F.when((kind == 0) | (kind == 2), key).alias("product_id"),
        F.when(kind == 1, number).when(kind == 2, F.when(F.col("o_orderkey") % 4 == 0, F.lit("0")).otherwise(number)).alias("product_number"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("quantity"), fields.alias("fields"))


ADDS = """
adds AS (SELECT 'C' || cast(o_custkey % 25 AS string) AS cellar_id, o_orderkey AS seq, o_custkey AS key, o_orderkey % 5 AS kind,
    (o_orderkey % 3 + 1) :: bigint AS quantity,
    o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 AS has_vintage, CASE WHEN o_orderkey % 3 = 0 THEN 2001 END AS own_vintage,
    CASE WHEN o_orderkey % 2 = 0 THEN 'shelf ' || cast(o_orderkey AS string) END AS location,
    CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' END AS currency
  FROM {orders}),
gr AS (SELECT product_id, string_agg(grape, ', ' ORDER BY grape) AS grapes FROM {grape} GROUP BY product_id),
resolved AS (SELECT a.cellar_id, a.seq, m.product_id, m.product_number, a.quantity, a.location, a.currency AS purchase_currency,
    CASE WHEN a.kind = 4 THEN 'Own ' || cast(a.key AS string) ELSE m.full_name END AS name, m.producer,
    CASE WHEN a.has_vintage THEN a.own_vintage ELSE m.vintage END :: bigint AS vintage,
    CASE WHEN m.origin2 IS NULL THEN m.origin1 ELSE m.origin1 || ', ' || m.origin2 END AS region, gr.grapes,
    m.vintage AS listed, m.product_id IS NOT NULL AND (CASE WHEN a.has_vintage THEN a.own_vintage ELSE m.vintage END) IS NOT DISTINCT FROM m.vintage AS same,
    m.sugar_g_per_100ml, m.abv, m.clock_body, m.clock_tannin, m.clock_sweetness, m.clock_fruitacid,
    CASE WHEN a.kind = 3 THEN 'needs a name' WHEN a.kind <> 4 AND m.product_id IS NULL THEN 'no such product' END AS reason
  FROM adds a LEFT JOIN {product} m ON a.kind IN (0, 1, 2) AND m.product_id = a.key AND NOT (a.kind = 2 AND a.seq % 4 = 0)
  LEFT JOIN gr ON gr.product_id = m.product_id)
"""


@add("resolve_adds", f"""
WITH {ADDS} SELECT cellar_id, seq, product_id, product_number, quantity, name, producer, vintage, region, grapes, location, purchase_currency,
  CASE WHEN same THEN floor(sugar_g_per_100ml * 100 + 0.5) / 10 END AS sugar_g_l, CASE WHEN same THEN abv END AS abv,
  CASE WHEN same AND NOT (coalesce(clock_body, 0) = 0 AND coalesce(clock_tannin, 0) = 0 AND coalesce(clock_sweetness, 0) = 0 AND coalesce(clock_fruitacid, 0) = 0)
    THEN clock_body END :: bigint AS clock_body,
  CASE WHEN product_id IS NOT NULL AND NOT same THEN 1 ELSE 0 END :: bigint AS other_vintage, reason
FROM resolved
""")
def resolve_adds(t: Source) -> DataFrame:
    noted = t.product.withColumn("taste", F.lit("note"))
    return commands.resolve_adds(_adds(t), noted, t.grape).select(
        "cellar_id", "seq", "product_id", "product_number", "quantity", "name", "producer", "vintage", "region", "grapes",
        "location", "purchase_currency", "sugar_g_l", "abv", "clock_body", "other_vintage", "reason")


RACKED = "(SELECT DISTINCT cellar_id FROM {rack})"
IN_SLOTS = "regexp_matches(upper(w.location), '(^|,)\\s*[A-Z]\\d{1,3}\\s*(,|$)')"
TOPPED = f"""
WITH {ADDS},
ok AS (SELECT *, row_number() OVER (PARTITION BY cellar_id, product_id, vintage ORDER BY seq) AS nth FROM resolved WHERE reason IS NULL),
old AS (SELECT w.*, CASE WHEN w.cellar_id IN {RACKED} AND coalesce({IN_SLOTS}, false) THEN 1 ELSE 0 END AS placed FROM {{wine}} w
  WHERE product_id IS NOT NULL),
held AS (SELECT k.*, o.wine_id, CASE WHEN o.placed = 1 AND k.location IS NULL THEN 1 ELSE 0 END AS homeless FROM ok k
  LEFT JOIN old o ON o.cellar_id = k.cellar_id AND o.product_id = k.product_id AND o.vintage IS NOT DISTINCT FROM k.vintage),
groups AS (SELECT cellar_id, product_id, vintage, CASE WHEN product_id IS NULL THEN seq END AS own, max(wine_id) AS wine_id, min(seq) AS seq,
    sum(quantity) :: bigint AS quantity, max_by(location, seq) FILTER (WHERE location IS NOT NULL) AS location, min_by(name, seq) AS name
  FROM held WHERE homeless = 0 GROUP BY 1, 2, 3, 4),
fresh AS (SELECT g.*, m.top + row_number() OVER (PARTITION BY g.cellar_id ORDER BY g.seq) AS new_id FROM groups g
  JOIN (SELECT cellar_id, max(wine_id) AS top FROM {{wine}} GROUP BY cellar_id) m ON m.cellar_id = g.cellar_id WHERE g.wine_id IS NULL)
"""


def _top_up(t: Source) -> commands.Applied:
    noted = t.product.withColumn("taste", F.lit("note"))
    return commands.apply_adds(_adds(t), noted, t.grape, t.wine, _racks(t), TODAY)


@add("top_up", TOPPED + """
SELECT w.cellar_id, w.wine_id, w.product_id, w.name, w.vintage :: bigint AS vintage, (w.quantity + coalesce(g.quantity, 0)) :: bigint AS quantity,
  coalesce(g.location, w.location) AS location
FROM {wine} w LEFT JOIN groups g ON g.cellar_id = w.cellar_id AND g.wine_id = w.wine_id
UNION ALL SELECT cellar_id, new_id, product_id, name, vintage, quantity, location FROM fresh
""")
def top_up(t: Source) -> DataFrame:
    return _top_up(t).wines.select("cellar_id", "wine_id", "product_id", "name", "vintage", "quantity", "location")


@add("top_up_events", TOPPED + """
SELECT h.cellar_id, coalesce(h.wine_id, f.new_id) AS wine_id, h.seq, h.quantity FROM held h
LEFT JOIN fresh f ON h.wine_id IS NULL AND f.cellar_id = h.cellar_id AND f.product_id IS NOT DISTINCT FROM h.product_id
  AND f.vintage IS NOT DISTINCT FROM h.vintage AND (f.own IS NULL OR f.own = h.seq)
WHERE h.homeless = 0
""")
def top_up_events(t: Source) -> DataFrame:
    return _top_up(t).events.select("cellar_id", "wine_id", "seq", "quantity")


@add("top_up_rejects", TOPPED + """
SELECT cellar_id, seq, reason FROM resolved WHERE reason IS NOT NULL
UNION ALL SELECT cellar_id, seq, 'needs a slot for each bottle' FROM held WHERE homeless = 1
""")
def top_up_rejects(t: Source) -> DataFrame:
    return _top_up(t).rejects


def _patches(t: Source) -> DataFrame:
    """One patch per event, of the wine of its user."""
    e = F.col("event_id")
    fields = F.map_filter(F.create_map(
        F.lit("notes"), F.when(e % 4 == 0, F.concat(F.lit("n"), e.cast("string"))),
        F.lit("vintage"), F.when(e % 7 == 0, F.lit("2005")),
        F.lit("quantity"), F.when(e % 5 == 0, (e % 9).cast("string")),
        F.lit("name"), F.when(e % 13 == 0, F.lit("Renamed")),
        F.lit("drink_until"), F.when(e % 17 == 0, F.lit("2030"))),
        lambda k, v: v.isNotNull() | ((k == "notes") & (e % 6 == 1)) | ((k == "name") & (e % 101 == 0)))
    return t.events.select(F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("cellar_id"),
                           F.col("user_id").alias("wine_id"), e.alias("seq"), fields.alias("fields"))


PATCHED = f"""
WITH raw AS (SELECT 'C' || cast(user_id % 25 AS string) AS cellar_id, user_id AS wine_id, event_id AS seq,
    event_id % 4 = 0 OR event_id % 6 = 1 AS has_notes, CASE WHEN event_id % 4 = 0 THEN 'n' || cast(event_id AS string) END AS notes,
    event_id % 7 = 0 AS has_vintage, event_id % 5 = 0 AS has_quantity, (event_id % 9) :: bigint AS quantity,
    event_id % 13 = 0 OR event_id % 101 = 0 AS has_name, CASE WHEN event_id % 13 = 0 THEN 'Renamed' END AS name,
    event_id % 17 = 0 AS has_until
  FROM {{events}}),
judged AS (SELECT r.*, w.quantity AS was, w.vintage AS old_vintage, CASE WHEN w.wine_id IS NULL THEN 'no such wine'
    WHEN r.has_name AND r.name IS NULL THEN 'name cannot be cleared'
    WHEN r.has_quantity AND r.quantity > 0 AND r.quantity <> w.quantity AND w.cellar_id IN {RACKED} AND coalesce({IN_SLOTS}, false)
      THEN 'needs a slot for each bottle' END AS reason
  FROM raw r LEFT JOIN {{wine}} w ON w.cellar_id = r.cellar_id AND w.wine_id = r.wine_id),
good AS (SELECT * FROM judged WHERE reason IS NULL)
"""


def _patched(t: Source) -> commands.Applied:
    return commands.apply_patch(_patches(t), t.wine, _racks(t), TODAY)


@add("apply_patch", PATCHED + """,
merged AS (SELECT cellar_id, wine_id, max(seq) FILTER (WHERE has_notes) AS n, max_by(coalesce(notes, '<null>'), seq) FILTER (WHERE has_notes) AS notes,
    bool_or(has_vintage) AS has_vintage, bool_or(has_vintage AND old_vintage IS DISTINCT FROM 2005) AS moved,
    max_by(quantity, seq) FILTER (WHERE has_quantity) AS quantity, bool_or(has_name) AS has_name, bool_or(has_until) AS has_until
  FROM good GROUP BY 1, 2)
SELECT w.cellar_id, w.wine_id, CASE WHEN m.has_name THEN 'Renamed' ELSE w.name END AS name,
  CASE WHEN m.n IS NOT NULL THEN nullif(m.notes, '<null>') ELSE w.notes END AS notes,
  CASE WHEN m.has_vintage THEN 2005 ELSE w.vintage END :: bigint AS vintage,
  coalesce(m.quantity, w.quantity) :: bigint AS quantity, CASE WHEN m.has_until THEN 2030 ELSE w.drink_until END :: bigint AS drink_until,
  CASE WHEN m.moved THEN NULL ELSE w.sb_taste END AS sb_taste, CASE WHEN m.moved THEN NULL ELSE w.clock_body END :: bigint AS clock_body,
  w.sugar_g_l
FROM {wine} w LEFT JOIN merged m USING (cellar_id, wine_id)
""")
def apply_patch(t: Source) -> DataFrame:
    return _patched(t).wines.select("cellar_id", "wine_id", "name", "notes", "vintage", "quantity", "drink_until",
                                    "sb_taste", "clock_body", "sugar_g_l")


@add("patch_events", PATCHED + """,
steps AS (SELECT cellar_id, wine_id, seq, quantity - coalesce(lag(quantity) OVER (PARTITION BY cellar_id, wine_id ORDER BY seq), was) AS step
  FROM good WHERE has_quantity)
SELECT cellar_id, wine_id, seq, 'adjusted' AS kind, step :: bigint AS quantity FROM steps WHERE step <> 0
""")
def patch_events(t: Source) -> DataFrame:
    return _patched(t).events.select("cellar_id", "wine_id", "seq", "kind", "quantity")


@add("patch_rejects", PATCHED + "SELECT cellar_id, wine_id, seq, reason FROM judged WHERE reason IS NOT NULL")
def patch_rejects(t: Source) -> DataFrame:
    return _patched(t).rejects


# Commands one after the other: each step of the recursion judges one command of each cellar
# against the list of its wines (k, count q, location, slots s) that the step before left.
WALKED = f"""
{GRID},
grids AS (SELECT cellar_id, list(slot) AS grid FROM grid GROUP BY cellar_id),
split AS (SELECT *, list_filter(list_transform(split(coalesce(location, ''), ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM cmd),
step AS MATERIALIZED (SELECT s.*, g.grid, list_filter(parts, lambda p: regexp_matches(p, '^[A-Z]\\d{{1,3}}$')) AS slots,
    row_number() OVER (PARTITION BY s.cellar_id ORDER BY seq) AS n FROM split s LEFT JOIN grids g ON g.cellar_id = s.cellar_id),
start AS (SELECT cellar_id, list({{k: k, q: q, location: location, s: s}}) AS st FROM (
    SELECT w.cellar_id, 'wine/' || cast(wine_id AS string) AS k, w.quantity :: bigint AS q, location,
      coalesce((SELECT list(part) FROM parts p WHERE p.cellar_id = w.cellar_id AND p.wine_id = w.wine_id AND regexp_matches(part, '^[A-Z]\\d{{1,3}}$')), []) AS s
    FROM {{wine}} w) x GROUP BY cellar_id),
walk AS (
  SELECT cellar_id, 0 :: bigint AS n, st, NULL :: bigint AS seq, NULL :: string AS k, NULL :: string AS reason FROM start
  UNION ALL
  SELECT cellar_id, n, CASE WHEN reason IS NULL THEN list_append(list_filter(st, lambda x: x.k <> k), {{k: k, q: total, location: place,
      s: CASE WHEN NOT shifted THEN before.s WHEN place IS NULL THEN [] ELSE slots END}}) ELSE st END, seq, k, reason
  FROM (
    SELECT *, CASE WHEN moves THEN true ELSE recount AND NOT adds AND total = 0 AND len(before.s) > 0 AND grid IS NOT NULL END AS shifted,
      CASE WHEN moves AND grid IS NOT NULL AND total = 0 AND len(slots) > 0 THEN NULL WHEN moves THEN location
        WHEN recount AND NOT adds AND total = 0 AND len(before.s) > 0 AND grid IS NOT NULL THEN NULL ELSE before.location END AS place,
      CASE WHEN grid IS NULL THEN NULL
        WHEN NOT moves AND recount AND total > 0 AND len(before.s) > 0 THEN 'needs a slot for each bottle'
        WHEN NOT moves OR len(slots) = 0 OR total = 0 THEN NULL
        WHEN len(list_filter(slots, lambda p: NOT list_contains(grid, p))) > 0 THEN 'outside the rack'
        WHEN len(list_distinct(slots)) < len(slots) THEN 'listed twice'
        WHEN len(parts) <> total THEN 'places differ from bottles'
        WHEN len(list_intersect(slots, flatten(list_transform(list_filter(st, lambda x: x.q > 0 AND x.k <> k), lambda x: x.s)))) > 0
          THEN 'held by another wine' END AS reason
    FROM (SELECT *, CASE WHEN adds THEN coalesce(before.q, 0) + quantity ELSE coalesce(quantity, before.q) END AS total,
        before IS NOT NULL AND CASE WHEN adds THEN true ELSE coalesce(quantity <> before.q, false) END AS recount
      FROM (SELECT w.st, s.*, list_filter(w.st, lambda x: x.k = s.k)[1] AS before FROM walk w JOIN step s ON s.cellar_id = w.cellar_id AND s.n = w.n + 1) a) b) c),
last AS (SELECT cellar_id, unnest(arg_max(st, n)) AS wine FROM walk GROUP BY cellar_id)
"""

PLACED_ADDS = """
WITH RECURSIVE cmd AS (SELECT a.cellar_id, a.seq, true AS adds, a.quantity :: bigint AS quantity, a.moves, a.location,
    CASE WHEN a.named THEN 'add/' || cast(a.seq AS string) WHEN w.wine_id IS NULL THEN 'product/' || cast(a.key AS string)
      ELSE 'wine/' || cast(w.wine_id AS string) END AS k
  FROM {placed_add} a LEFT JOIN {wine} w ON NOT a.named AND w.cellar_id = a.cellar_id AND w.product_id = a.key),
""" + WALKED


def _placed_adds(t: Source) -> commands.Applied:
    key = F.col("key")
    fields = F.map_filter(F.create_map(
        F.lit("name"), F.when(F.col("named"), F.concat(F.lit("Own "), key.cast("string"))),
        F.lit("vintage"), F.when(key % 5 != 0, (F.lit(1990) + key % 30).cast("string")), F.lit("location"), F.col("location")),
        lambda k, v: v.isNotNull() | ((k == "location") & F.col("moves")) | (k == "vintage"))
    adds = t.placed_add.select("cellar_id", "seq", F.when(~F.col("named"), key).alias("product_id"), F.lit(None).cast("string").alias("product_number"),
                               "quantity", fields.alias("fields"))
    noted = t.product.withColumn("taste", F.lit("note"))
    return commands.apply_adds(adds, noted, t.grape, t.wine, _racks(t), TODAY, racks=_racks(t))


@add("top_up_placement", PLACED_ADDS + """,
fresh AS (SELECT f.cellar_id, f.k, m.top + row_number() OVER (PARTITION BY f.cellar_id ORDER BY f.seq) AS wine_id
  FROM (SELECT cellar_id, k, min(seq) AS seq FROM walk WHERE reason IS NULL AND seq IS NOT NULL AND NOT starts_with(k, 'wine/') GROUP BY 1, 2) f
  JOIN (SELECT cellar_id, max(wine_id) AS top FROM {wine} GROUP BY 1) m ON m.cellar_id = f.cellar_id)
SELECT l.cellar_id, coalesce(f.wine_id, try_cast(substr(wine.k, 6) AS bigint)) AS wine_id, wine.q AS quantity, wine.location AS location
FROM last l LEFT JOIN fresh f ON f.cellar_id = l.cellar_id AND f.k = wine.k
""")
def top_up_placement(t: Source) -> DataFrame:
    return _placed_adds(t).wines.select("cellar_id", "wine_id", "quantity", "location")


@add("top_up_placement_rejects", PLACED_ADDS + "SELECT cellar_id, seq, reason FROM walk WHERE reason IS NOT NULL")
def top_up_placement_rejects(t: Source) -> DataFrame:
    return _placed_adds(t).rejects


PLACED_PATCHES = """
WITH RECURSIVE cmd AS (SELECT p.cellar_id, p.seq, false AS adds, p.quantity :: bigint AS quantity, p.moves, p.location, 'wine/' || cast(p.wine_id AS string) AS k
  FROM {placed_patch} p WHERE EXISTS (SELECT 1 FROM {wine} w WHERE w.cellar_id = p.cellar_id AND w.wine_id = p.wine_id)),
""" + WALKED


def _placed_patches(t: Source) -> commands.Applied:
    fields = F.map_filter(F.create_map(F.lit("quantity"), F.col("quantity").cast("string"), F.lit("location"), F.col("location")),
                          lambda k, v: v.isNotNull() | ((k == "location") & F.col("moves")))
    patches = t.placed_patch.select("cellar_id", "wine_id", "seq", fields.alias("fields"))
    return commands.apply_patch(patches, t.wine, _racks(t), TODAY, racks=_racks(t))


@add("patch_placement", PLACED_PATCHES + """
SELECT cellar_id, cast(substr(wine.k, 6) AS bigint) AS wine_id, wine.q AS quantity, wine.location AS location FROM last
""")
def patch_placement(t: Source) -> DataFrame:
    return _placed_patches(t).wines.select("cellar_id", "wine_id", "quantity", "location")


@add("patch_placement_rejects", PLACED_PATCHES + """
SELECT cellar_id, cast(substr(k, 6) AS bigint) AS wine_id, seq, reason FROM walk WHERE reason IS NOT NULL
UNION ALL SELECT cellar_id, wine_id, seq, 'no such wine' FROM {placed_patch} p
WHERE NOT EXISTS (SELECT 1 FROM {wine} w WHERE w.cellar_id = p.cellar_id AND w.wine_id = p.wine_id)
""")
def patch_placement_rejects(t: Source) -> DataFrame:
    return _placed_patches(t).rejects


def _removed(t: Source) -> commands.Applied:
    """Commands that name no slot, on wines given enough bottles to have a history."""
    wines = t.wine.withColumn("quantity", (F.lit(20) + F.col("wine_id") % 60).cast("int"))
    cmds = t.removal.withColumn("note", F.lit(None).cast("string")).withColumn("slots", F.array().cast("array<string>"))
    return commands.apply_removals(cmds, wines, t.spark.createDataFrame([], "cellar_id STRING"), TODAY)


FOLDED = """
WITH RECURSIVE c AS (SELECT r.cellar_id, r.wine_id, r.seq, r.quantity, w.start, row_number() OVER (PARTITION BY r.wine_id ORDER BY r.seq) AS n
  FROM {removal} r JOIN (SELECT cellar_id, wine_id, 20 + wine_id % 60 AS start FROM {wine}) w ON w.cellar_id = r.cellar_id AND w.wine_id = r.wine_id),
walk AS (SELECT cellar_id, wine_id, n, seq, quantity, quantity <= start AS ok, CASE WHEN quantity <= start THEN start - quantity ELSE start END AS bal FROM c WHERE n = 1
  UNION ALL SELECT c.cellar_id, c.wine_id, c.n, c.seq, c.quantity, c.quantity <= walk.bal, CASE WHEN c.quantity <= walk.bal THEN walk.bal - c.quantity ELSE walk.bal END
  FROM walk JOIN c ON c.wine_id = walk.wine_id AND c.n = walk.n + 1)
"""


@add("apply_removals", FOLDED + """
SELECT w.cellar_id, w.wine_id, (20 + w.wine_id % 60 - coalesce(o.taken, 0)) :: bigint AS quantity FROM {wine} w
LEFT JOIN (SELECT wine_id, sum(quantity) AS taken FROM walk WHERE ok GROUP BY wine_id) o USING (wine_id)
""")
def apply_removals(t: Source) -> DataFrame:
    return _removed(t).wines.select("cellar_id", "wine_id", "quantity")


@add("removal_events", FOLDED + """
SELECT k.cellar_id, k.wine_id, k.seq, r.reason, r.on_date, r.rating :: bigint AS rating, -k.quantity :: bigint AS quantity
FROM walk k JOIN {removal} r ON r.seq = k.seq WHERE k.ok
""")
def removal_events(t: Source) -> DataFrame:
    return _removed(t).events.select("cellar_id", "wine_id", "seq", "reason", "on_date", "rating", "quantity")


# --- reviews ------------------------------------------------------------------

@add("review_violations", """
SELECT cellar_id, review_id, array_to_string(list_filter([
  CASE WHEN score IS NULL AND award IS NULL AND summary IS NULL THEN 'needs a score, an award or a summary' END,
  CASE WHEN score > scale THEN 'score above its scale' END, CASE WHEN drink_from > drink_until THEN 'window runs backwards' END],
  lambda x: x IS NOT NULL), '|') AS reasons
FROM {review} WHERE (score IS NULL AND award IS NULL AND summary IS NULL) OR score > scale OR drink_from > drink_until
""")
def review_violations(t: Source) -> DataFrame:
    return reviews.review_violations(t.review)


def _recorded(t: Source) -> reviews.Reviewed:
    held = t.review.filter(F.col("review_id") % 2 == 0)
    batch = t.review.select("cellar_id", "wine_id", F.col("review_id").alias("seq"), *spec.REVIEW_FIELDS).withColumn(
        "summary", F.concat(F.lit("new "), F.col("seq").cast("string"))).withColumn("scale", F.lit(None).cast("double"))
    return reviews.upsert_reviews(batch, held, t.wine, TODAY)


RECORDED = """
WITH held AS (SELECT * FROM {review} WHERE review_id % 2 = 0),
judged AS (SELECT r.*, 'new ' || cast(review_id AS string) AS text, w.wine_id IS NULL AS lost FROM {review} r LEFT JOIN {wine} w USING (cellar_id, wine_id)),
good AS (SELECT * FROM judged WHERE NOT lost AND NOT (drink_from > drink_until)),
latest AS (SELECT cellar_id, wine_id, lower(critic) AS k, tasted_on, max(review_id) AS last, min(review_id) AS first FROM good GROUP BY 1, 2, 3, 4),
cur AS (SELECT cellar_id, wine_id, lower(critic) AS k, tasted_on, min(review_id) AS id FROM held GROUP BY 1, 2, 3, 4),
m AS (SELECT l.*, c.id FROM latest l LEFT JOIN cur c ON c.cellar_id = l.cellar_id AND c.wine_id = l.wine_id AND c.k = l.k AND c.tasted_on IS NOT DISTINCT FROM l.tasted_on),
top AS (SELECT cellar_id, max(review_id) AS top FROM held GROUP BY 1),
ids AS (SELECT m.cellar_id, m.last, m.id AS review_id FROM m WHERE id IS NOT NULL
  UNION ALL SELECT m.cellar_id, m.last, top.top + row_number() OVER (PARTITION BY m.cellar_id ORDER BY m.first) FROM m JOIN top USING (cellar_id) WHERE m.id IS NULL)
"""


@add("upsert_reviews", RECORDED + """
SELECT i.cellar_id, i.review_id, g.wine_id, g.critic, g.tasted_on, g.score, CASE WHEN g.score IS NOT NULL THEN 100.0e0 END AS scale, g.text AS summary, '2026-09-01' AS recorded_on
FROM ids i JOIN good g ON g.review_id = i.last
UNION ALL SELECT cellar_id, review_id, wine_id, critic, tasted_on, score, scale, summary, recorded_on FROM held h
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cellar_id = h.cellar_id AND m.id = h.review_id)
""")
def upsert_reviews(t: Source) -> DataFrame:
    return _recorded(t).reviews.select("cellar_id", "review_id", "wine_id", "critic", "tasted_on", "score", "scale", "summary", "recorded_on")


@add("review_rejects", RECORDED + """
SELECT cellar_id, wine_id, review_id AS seq, CASE WHEN lost THEN 'no such wine' ELSE 'window runs backwards' END AS reason
FROM judged WHERE lost OR drink_from > drink_until
""")
def review_rejects(t: Source) -> DataFrame:
    return _recorded(t).rejects


@add("reviews_checked", RECORDED + """
SELECT cellar_id, wine_id, CASE WHEN EXISTS (SELECT 1 FROM good g WHERE g.cellar_id = w.cellar_id AND g.wine_id = w.wine_id) THEN '2026-09-01'
  ELSE reviews_checked_on END AS reviews_checked_on FROM {wine} w
""")
def reviews_checked(t: Source) -> DataFrame:
    return _recorded(t).wines.select("cellar_id", "wine_id", "reviews_checked_on")


def _patched_reviews(t: Source) -> tuple[DataFrame, DataFrame]:
    e = F.col("review_id")
    fields = F.map_filter(F.create_map(
        F.lit("score"), F.when(e % 4 == 0, F.lit("88.5")), F.lit("award"), F.when(e % 9 == 0, F.lit("Silver")),
        F.lit("critic"), F.when(e % 10 == 0, F.lit("Renamed")), F.lit("summary"), F.lit(None).cast("string")),
        lambda k, v: v.isNotNull() | ((k == "score") & (e % 4 == 1)) | ((k == "critic") & (e % 35 == 1)) | ((k == "summary") & (e % 8 == 1)))
    patches = t.review.select("cellar_id", "review_id", e.alias("seq"), fields.alias("fields"))
    return reviews.patch_reviews(patches, t.review, TODAY)


PATCHED_REVIEWS = """
WITH p AS (SELECT *, CASE WHEN review_id % 4 = 0 THEN 88.5e0 WHEN review_id % 4 = 1 THEN NULL ELSE score END AS s,
    CASE WHEN review_id % 9 = 0 THEN 'Silver' ELSE award END AS a, CASE WHEN review_id % 10 = 0 THEN 'Renamed' ELSE critic END AS c,
    CASE WHEN review_id % 8 = 1 THEN NULL ELSE summary END AS t, review_id % 35 = 1 AND review_id % 10 <> 0 AS cleared FROM {review}),
q AS (SELECT *, CASE WHEN s IS NOT NULL THEN coalesce(scale, 100.0e0) END AS new_scale FROM p),
j AS (SELECT *, CASE WHEN cleared THEN 'critic cannot be cleared' WHEN s IS NULL AND a IS NULL AND t IS NULL THEN 'needs a score, an award or a summary'
    WHEN s > new_scale THEN 'score above its scale' WHEN drink_from > drink_until THEN 'window runs backwards' END AS reason FROM q)
"""


@add("patch_reviews", PATCHED_REVIEWS + """
SELECT cellar_id, review_id, CASE WHEN reason IS NULL THEN c ELSE critic END AS critic, CASE WHEN reason IS NULL THEN s ELSE score END AS score,
  CASE WHEN reason IS NULL THEN new_scale ELSE scale END AS scale, CASE WHEN reason IS NULL THEN a ELSE award END AS award,
  CASE WHEN reason IS NULL THEN t ELSE summary END AS summary, CASE WHEN reason IS NULL THEN '2026-09-01' ELSE recorded_on END AS recorded_on FROM j
""")
def patch_reviews(t: Source) -> DataFrame:
    return _patched_reviews(t)[0].select("cellar_id", "review_id", "critic", "score", "scale", "award", "summary", "recorded_on")


@add("patch_review_rejects", PATCHED_REVIEWS + "SELECT cellar_id, review_id, review_id AS seq, reason FROM j WHERE reason IS NOT NULL")
def patch_review_rejects(t: Source) -> DataFrame:
    return _patched_reviews(t)[1]


@add("delete_reviews", "SELECT cellar_id, review_id FROM {review} WHERE NOT coalesce(score > scale, false)")
def delete_reviews(t: Source) -> DataFrame:
    return reviews.delete_reviews(t.review, t.review.filter(F.col("score") > F.col("scale"))).select("cellar_id", "review_id")


@add("mark_checked", """
SELECT cellar_id, wine_id, CASE WHEN quantity = 0 THEN '2026-09-01' ELSE reviews_checked_on END AS reviews_checked_on FROM {wine}
""")
def mark_checked(t: Source) -> DataFrame:
    return reviews.mark_checked(t.wine, t.wine.filter(F.col("quantity") == 0), TODAY).select("cellar_id", "wine_id", "reviews_checked_on")


@add("reviews_of", """
SELECT cellar_id, wine_id, review_id, tasted_on FROM {review} r WHERE EXISTS (SELECT 1 FROM {wine} w WHERE w.cellar_id = r.cellar_id
  AND w.wine_id = r.wine_id AND w.quantity > 0)
""")
def reviews_of(t: Source) -> DataFrame:
    return reviews.reviews_of(t.review, t.wine.filter(F.col("quantity") > 0)).select("cellar_id", "wine_id", "review_id", "tasted_on")
