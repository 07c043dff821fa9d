"""The catalogue's questions: search, releases, product pages, stores, stock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise import spec
from shelfwise.functions.strings import any_contains
from shelfwise.functions.text import Expr, text_match
from shelfwise.operators import filters, joins
from shelfwise.sources.scratch import staged

NOTE_COLUMNS = ("full_name", "producer", "taste", "color", "usage")


def sort_order(mode: str, key: str = "product_id") -> list[Column]:
    """The listing orders, made total by the id. NULLs sort first ascending, last descending."""
    orders = {
        "price_asc": [F.col("price").asc_nulls_first()],
        "price_desc": [F.col("price").desc_nulls_last()],
        "value": [F.col("sek_per_litre").asc_nulls_first()],
        "body_desc": [F.col("clock_body").desc_nulls_last(), F.col("price").asc_nulls_first()],
        "name": [F.col("full_name").asc_nulls_first()],
    }
    if mode not in orders:
        raise ValueError(f"unknown sort {mode!r}; one of {sorted(orders)}")
    return [*orders[mode], F.col(key).asc()]


def sort_by(df: DataFrame, mode: str = "price_asc", key: str = "product_id") -> DataFrame:
    return df.orderBy(*sort_order(mode, key))


def with_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """All rows with their place, 1, 2, 3 ..., in a total order.

    The order is cut into ranges, each sorted by a task of its own. A row's place is its
    place in its range and the rows of all ranges before, from one summary row per range:
    no task sees the whole order. The sorted rows are staged, since a range's number and
    its rows' places must not be computed twice.
    """
    place = F.monotonically_increasing_id()  # the range's number above 33 bits of the place in it
    ordered = staged(df.orderBy(*order).withColumn("_place", place), "ranked").withColumn("_range", F.shiftright("_place", 33))
    sizes = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.join(offsets, "_range").select(*df.columns, (F.col("_before") + within).alias(out))


@dataclass(frozen=True)
class Page:
    """One page of a result: ``items`` and a one-row ``meta``."""

    items: DataFrame
    meta: DataFrame


def page(df: DataFrame, order: list[Column], limit: int = spec.DEFAULT_PAGE, offset: int = 0,
         max_limit: int = spec.MAX_PAGE) -> Page:
    """A page of an ordered result with total, count, has_more and next_offset.

    The order must be total. Items are a top-n (each task keeps limit + offset
    rows); the total is an aggregate of its own.
    """
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be 1 to {max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    items = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    left = F.greatest(F.col("total") - offset, F.lit(0))
    count = F.least(left, F.lit(limit)).cast("bigint")
    more = F.col("total") > F.lit(offset) + F.col("count")
    meta = total.withColumn("count", count).select(
        "total", "count", F.lit(offset).cast("bigint").alias("offset"), more.alias("has_more"),
        F.when(more, F.lit(offset) + F.col("count")).alias("next_offset"))
    return Page(items, meta)


@dataclass(frozen=True)
class Search:
    """Parameters of a product search; unset ones do not filter."""

    name: str | None = None
    category: str | None = None
    country: str | None = None
    grape: str | None = None
    exclude_grape: str | None = None
    pairing: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    store_id: object = None
    organic: bool = False
    vegan: bool = False
    min_body: int | None = None
    max_body: int | None = None
    min_tannin: int | None = None
    max_tannin: int | None = None
    max_sweetness: int | None = None
    min_fruitacid: int | None = None
    max_availability_rank: int = 1
    sort: str = "price_asc"
    limit: int = spec.DEFAULT_PAGE
    offset: int = 0


@dataclass(frozen=True)
class Catalogue:
    """The catalogue's tables."""

    product: DataFrame
    grape: DataFrame
    pairing: DataFrame
    store: DataFrame
    store_product: DataFrame


def matching_products(tables: Catalogue, p: Search) -> DataFrame:
    """Every product a search matches, unordered. Column filters come before joins."""
    out = filters.common_filters(tables.product, p.max_availability_rank, p.category, p.country,
                                 p.min_price, p.max_price)
    if p.name is not None:
        out = filters.name_match(out, p.name)
    out = filters.dietary(out, p.organic, p.vegan)
    out = filters.clock_range(out, p.min_body, p.max_body, p.min_tannin, p.max_tannin,
                              p.max_sweetness, p.min_fruitacid)
    if p.store_id is not None:
        out = filters.having(out, tables.store_product, "product_id", "site_id", p.store_id)
    if p.grape is not None:
        out = filters.having(out, tables.grape, "product_id", "grape", p.grape)
    if p.exclude_grape is not None:
        out = filters.having_not(out, tables.grape, "product_id", "grape", p.exclude_grape)
    if p.pairing is not None:
        out = filters.having(out, tables.pairing, "product_id", "pairing", p.pairing)
    return out


def search_products(tables: Catalogue, p: Search) -> Page:
    """A page of products in listing columns."""
    found = matching_products(tables, p)
    result = page(found, sort_order(p.sort), p.limit, p.offset)
    return Page(filters.list_columns(result.items), result.meta)


def search_notes(df: DataFrame, expr: Expr, columns: tuple[str, ...] = NOTE_COLUMNS, max_rank: int = 1,
                 category: str | None = None, country: str | None = None, min_price: float | None = None,
                 max_price: float | None = None, store_id=None, store_product: DataFrame | None = None,
                 limit: int = spec.DEFAULT_PAGE, offset: int = 0) -> Page:
    """A page of products whose text satisfies a boolean expression, cheapest first.

    The cheap column filters and the store list cut rows before any text is tokenised.
    """
    narrowed = filters.common_filters(df, max_rank, category, country, min_price, max_price, store_id, store_product)
    found = text_match(narrowed, expr, columns)
    result = page(found, sort_order("price_asc"), limit, offset)
    return Page(filters.list_columns(result.items), result.meta)


def launch_day(col: str = "launch_date") -> Column:
    """The day of an ISO timestamp kept as text."""
    return F.substring(F.col(col), 1, 10)


def limited_release(col: str = "assortment_code") -> Column:
    """Codes that begin with TS in either case."""
    return F.startswith(F.upper(F.col(col)), F.lit("TS"))


def releases(products: DataFrame, start: date, end: date | None = None, limited_only: bool = False,
             web_launches: str = "include", category: str | None = None, country: str | None = None,
             min_price: float | None = None, max_price: float | None = None, store_id=None,
             store_product: DataFrame | None = None) -> DataFrame:
    """Every product launching in an inclusive window of days (two weeks unless told).

    Order-only products stay in scope: a coming release is on no shelf yet.
    """
    end = end or start + timedelta(days=14)
    if end < start:
        raise ValueError(f"end ({end}) is before start ({start})")
    if web_launches not in ("include", "exclude", "only"):
        raise ValueError("web_launches is include, exclude or only")
    out = filters.common_filters(products, 3, category, country, min_price, max_price, store_id, store_product)
    day = launch_day()
    out = out.filter((day >= start.isoformat()) & (day <= end.isoformat()))
    if limited_only:
        out = out.filter(limited_release())
    if web_launches == "only":
        out = out.filter(F.col("is_web_launch"))
    if web_launches == "exclude":
        out = out.filter(~F.col("is_web_launch"))
    return out


RELEASE_ORDER = (("launch_date", "asc"), ("price", "desc"), ("product_id", "asc"))


def upcoming_releases(products: DataFrame, start: date, end: date | None = None,
                      limit: int = spec.DEFAULT_PAGE, offset: int = 0, **narrowing) -> Page:
    """A page of releases by day, dearest first within a day."""
    found = releases(products, start, end, **narrowing)
    order = [F.col("launch_date").asc_nulls_first(), F.col("price").desc_nulls_last(), F.col("product_id").asc()]
    result = page(found, order, limit, offset)
    extra = ("launch_date", "sell_start_time", "assortment_code", "is_web_launch")
    return Page(filters.list_columns(result.items, extra), result.meta)


def nearest_release_days(products: DataFrame, start: date, n: int = 5, limited_only: bool = False) -> DataFrame:
    """(launch_day, products) of the next days with releases, whatever else was asked."""
    out = products.filter(F.col("launch_date") >= start.isoformat())
    if limited_only:
        out = out.filter(limited_release())
    days = out.groupBy(launch_day().alias("launch_day")).agg(F.count(F.lit(1)).alias("products"))
    return days.orderBy("launch_day").limit(n)


def product_detail(tables: Catalogue, ids: DataFrame, columns: tuple[str, ...] = spec.DETAIL_COLUMNS,
                   key: str = "product_id") -> DataFrame:
    """Product pages: columns, sorted grapes, sorted pairings, carrying stores by name.

    Child rows are reduced to the asked ids before they are gathered; each list
    is bounded by its vocabulary (grapes, pairings, stores).
    """
    wanted = ids.select(F.col(key).alias("_want")).distinct()

    def of_wanted(child: DataFrame) -> DataFrame:
        return child.join(wanted, F.col(key) == F.col("_want"), "left_semi")

    grapes = of_wanted(tables.grape).groupBy(key).agg(F.array_sort(F.collect_set("grape")).alias("grapes"))
    pairs = of_wanted(tables.pairing).groupBy(key).agg(F.array_sort(F.collect_set("pairing")).alias("pairings"))
    named = tables.store.select("site_id", "name")
    carried = of_wanted(tables.store_product.select("site_id", key)).join(named, "site_id").groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct("name", "site_id"))).alias("carried_by"))
    out = of_wanted(tables.product).select(*[c for c in columns if c in tables.product.columns])
    return out.join(grapes, key, "left").join(pairs, key, "left").join(carried, key, "left")


def _store_order() -> list[Column]:
    return [F.col("products").desc(), F.col("name").asc(), F.col("site_id").asc()]


def list_stores(store: DataFrame, store_product: DataFrame, search: str | None = None,
                mirrored_only: bool = False) -> DataFrame:
    """All stores with their product count, in order; a store is mirrored when it has any. ``stores_page`` gives a page of them."""
    found = store if search is None else store.filter(any_contains(["name", "city", "county"], search))
    counted = joins.count_per_row(found.select("site_id", "name", "city", "county"), store_product, "site_id", "products")
    out = counted.withColumn("mirrored", F.col("products") > 0)
    if mirrored_only:
        out = out.filter("mirrored")
    return out.orderBy(*_store_order())


def stores_page(store: DataFrame, store_product: DataFrame, search: str | None = None, mirrored_only: bool = False,
                limit: int = spec.DEFAULT_PAGE, offset: int = 0) -> Page:
    """One page of ``list_stores`` with its total."""
    return page(list_stores(store, store_product, search, mirrored_only), _store_order(), limit, offset)


def reading_result(status: Column, stock: Column) -> tuple[Column, Column]:
    """(stock, error) of one reading: not found is zero, any other failure is unknown."""
    ok = (status >= 200) & (status < 300)
    value = F.when(status == 404, F.lit(0)).when(ok, F.coalesce(stock, F.lit(0)))
    error = F.when(~ok & (status != 404), F.concat(F.lit("stock lookup failed with status "), status.cast("string")))
    return value, error


def latest_readings(readings: DataFrame, keys: tuple[str, ...] = ("site_id", "product_id"), ts: str = "ts") -> DataFrame:
    """The latest reading per store and product; of equal times the greatest row, so a replay changes nothing."""
    rest = [c for c in readings.columns if c not in keys and c != ts]
    latest = readings.groupBy(*keys).agg(F.max(F.struct(F.col(ts), *rest)).alias("_r"))
    return latest.select(*keys, "_r.*").select(*readings.columns)


def latest_stock(readings: DataFrame, shortlist: DataFrame, products: DataFrame) -> DataFrame:
    """Shortlisted (site_id, product_id) with the latest stock, the product's name and what went wrong.

    Readings are cut to the shortlist before they are aggregated.
    """
    asked = shortlist.select("site_id", "product_id").distinct()
    latest = latest_readings(readings.join(asked, ["site_id", "product_id"], "left_semi"))
    stock, error = reading_result(F.col("status"), F.col("stock"))
    checked = latest.select("site_id", "product_id", F.col("ts").alias("checked_at"),
                            stock.alias("stock"), error.alias("error"), F.lit(True).alias("checked"))
    named = products.select("product_id", "full_name")
    joined = asked.join(checked, ["site_id", "product_id"], "left").join(named, "product_id", "left")
    return joined.select("site_id", "product_id", "full_name", "checked_at", "stock", "error",
                         F.coalesce("checked", F.lit(False)).alias("checked"))


def carried_or_unknown(pairs: DataFrame, store_product: DataFrame, products: DataFrame,
                       last_sync: datetime | Column) -> DataFrame:
    """(site_id, product_id, carried): true, false, or NULL where absence says nothing --
    the store is not mirrored, or the product launched after the last sync."""
    sync_day = F.date_format(last_sync if isinstance(last_sync, Column) else F.lit(last_sync), "yyyy-MM-dd")
    rows = store_product.select("site_id", "product_id").distinct().withColumn("_has", F.lit(True))
    mirrored = store_product.select("site_id").distinct().withColumn("_mirrored", F.lit(True))
    launched = products.select("product_id", launch_day().alias("_launch"))
    joined = (pairs.join(rows, ["site_id", "product_id"], "left").join(mirrored, "site_id", "left")
              .join(launched, "product_id", "left"))
    unknown = F.col("_mirrored").isNull() | F.coalesce(F.col("_launch") > sync_day, F.lit(False))
    carried = F.when(F.col("_has"), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.select(*pairs.columns, carried.alias("carried"))


def best_value(df: DataFrame, n: int = 10, key: str = "product_id") -> DataFrame:
    """The cheapest per litre among the rows given."""
    priced = df.filter(F.col("sek_per_litre").isNotNull())
    return priced.orderBy("sek_per_litre", key).limit(n)
