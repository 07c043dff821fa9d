"""The inventory ledger of many cellars: balances, ratings, lists, totals.

Every key is (cellar_id, wine_id); all aggregates combine map-side, so a wine
with very many events costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import spec
from shelfwise.functions import cellar as rules
from shelfwise.functions.strings import any_contains
from shelfwise.operators import joins

KEYS = ["cellar_id", "wine_id"]
SEARCHED = ("name", "producer", "region", "country", "grapes", "style", "notes", "profile")


def balance() -> Column:
    return F.sum("quantity").cast("bigint")


def summary_columns() -> list[Column]:
    """Aggregates of the event ledger, shared by the batch and the streaming form."""
    drunk = (F.col("kind") == "removed") & (F.col("reason") == "drunk")
    return [
        F.round(F.avg("rating"), 1).alias("avg_rating"),
        (-F.coalesce(F.sum(F.when(drunk, F.col("quantity"))), F.lit(0))).cast("bigint").alias("times_drunk"),
        F.max(F.when(F.col("note").isNotNull(), F.struct("on_date", "event_id", "note")))["note"].alias("last_note"),
    ]


def ledger_balance(events: DataFrame, wines: DataFrame | None = None) -> DataFrame:
    """(cellar_id, wine_id, quantity) as the sum of signed changes; wines without events count 0."""
    sums = events.groupBy(*KEYS).agg(balance().alias("quantity"))
    if wines is None:
        return sums
    return wines.select(*KEYS).join(sums, KEYS, "left").select(*KEYS, F.coalesce("quantity", F.lit(0)).alias("quantity"))


def ledger_summary(events: DataFrame) -> DataFrame:
    """(cellar_id, wine_id, avg_rating, times_drunk, last_note)."""
    return events.groupBy(*KEYS).agg(*summary_columns())


def with_summary(wines: DataFrame, events: DataFrame) -> DataFrame:
    joined = wines.join(ledger_summary(events), KEYS, "left")
    return joined.withColumn("times_drunk", F.coalesce("times_drunk", F.lit(0)))


def with_windows(wines: DataFrame, year: int) -> DataFrame:
    """The four overlapping window filters as columns, and the one-label state."""
    frm, until = F.col("drink_from"), F.col("drink_until")
    return wines.withColumns({
        **{kind: rules.drink_window(kind, frm, until, year) for kind in spec.DRINK_WINDOWS},
        "window_state": rules.window_state(frm, until, year),
    })


def cellar_order(sort: str) -> list[Column]:
    orders = {
        "drink_until": [F.col("drink_until").asc_nulls_last(), F.col("drink_from").asc_nulls_last(),
                        F.col("name").asc()],
        "name": [F.lower("name").asc(), F.col("vintage").asc_nulls_first()],
        "vintage": [F.col("vintage").asc_nulls_last(), F.col("name").asc()],
        "added": [F.col("added_at").desc()],
        "rating": [F.col("avg_rating").desc_nulls_last(), F.col("name").asc()],
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}; one of {sorted(orders)}")
    return [*orders[sort], F.col("cellar_id").asc(), F.col("wine_id").asc()]


def list_cellar(wines: DataFrame, events: DataFrame, reviews: DataFrame | None = None, year: int | None = None,
                wine_id: int | None = None, search: str | None = None, category: str | None = None,
                drink_window: str | None = None, min_rating: float | None = None, needs_profile: bool = False,
                needs_reviews: bool = False, include_empty: bool = False) -> DataFrame:
    """Wines with their ledger summary; empty ones are hidden unless asked for.

    Filters on wine columns are applied before the ledger is joined.
    """
    out = wines
    if wine_id is not None:
        out = out.filter(F.col("wine_id") == wine_id)
    elif not include_empty:
        out = out.filter(F.col("quantity") > 0)
    if search is not None:
        out = out.filter(any_contains(list(SEARCHED), search))
    if category is not None:
        out = out.filter(F.lower("category") == category.lower())
    if drink_window is not None:
        out = out.filter(rules.drink_window(drink_window, F.col("drink_from"), F.col("drink_until"), year))
    if needs_profile:
        out = out.filter(F.col("sb_taste").isNull() & F.col("profile").isNull())
    if needs_reviews:
        seen = reviews.select(*KEYS).distinct()
        out = out.filter(F.col("reviews_checked_on").isNull()).join(seen, KEYS, "left_anti")
    out = with_summary(out, events)
    if min_rating is not None:
        out = out.filter(F.col("avg_rating") >= min_rating)
    return out


def sort_cellar(listed: DataFrame, sort: str = "drink_until") -> DataFrame:
    return listed.orderBy(*cellar_order(sort))


def current_listing(wines: DataFrame, products: DataFrame) -> DataFrame:
    """What the shop sells under each wine's product id today, and whether it is the same vintage."""
    return joins.attach_listing(wines, products)


def summary(wines: DataFrame) -> DataFrame:
    """(cellar_id, wines, bottles) over wines with bottles."""
    return wines.filter(F.col("quantity") > 0).groupBy("cellar_id").agg(
        F.count(F.lit(1)).alias("wines"), F.sum("quantity").cast("bigint").alias("bottles"))


def paid_by_currency(wines: DataFrame) -> DataFrame:
    """(cellar_id, currency, total) of what was paid, never converted; no currency means the home one."""
    paid = wines.filter((F.col("quantity") > 0) & F.col("purchase_price").isNotNull())
    return paid.groupBy("cellar_id", F.coalesce("purchase_currency", F.lit(spec.HOME_CURRENCY)).alias("currency")).agg(
        F.round(F.sum(F.col("quantity") * F.col("purchase_price")), 2).alias("total"))


def signed(quantity: Column) -> Column:
    """'+3' or '-1'."""
    return F.concat(F.when(quantity > 0, F.lit("+")).otherwise(F.lit("")), quantity.cast("string"))


def history(events: DataFrame, wines: DataFrame | None = None) -> DataFrame:
    """Events by wine, day and id with the change as signed text; ``wines`` narrows to some wines."""
    out = events if wines is None else events.join(wines.select(*KEYS).distinct(), KEYS, "left_semi")
    return out.withColumn("change", signed(F.col("quantity"))).orderBy(*KEYS, "on_date", "event_id")


def clear_unrated_clocks(wines: DataFrame) -> DataFrame:
    """Four zero clocks mean 'not rated': NULL them. Any other combination is kept."""
    zero = F.lit(True)
    for clock in spec.CLOCKS:
        zero = zero & (F.col(clock) == 0)
    unrated = F.coalesce(zero, F.lit(False))
    return wines.withColumns({c: F.when(~unrated, F.col(c)) for c in spec.CLOCKS})


def profile_violations(wines: DataFrame) -> DataFrame:
    """(cellar_id, wine_id, rule) for wines breaking a profile, date or window rule."""
    checks = [
        ("profile without sources",
         (F.coalesce("profile", F.lit("")) != "") & (F.coalesce("profile_sources", F.lit("")) == "")),
        ("currency not normalised", F.col("purchase_currency") != rules.normal_currency(F.col("purchase_currency"))),
        ("invalid purchase date", ~rules.valid_partial_date(F.col("purchased_on"))),
        ("invalid disgorgement date", ~rules.valid_partial_date(F.col("disgorged_on"))),
        ("window runs backwards", F.col("drink_from") > F.col("drink_until")),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in checks]))
    return wines.select(*KEYS, F.explode(broken).alias("rule"))


def normalise_currency(wines: DataFrame) -> DataFrame:
    return wines.withColumn("purchase_currency", rules.normal_currency(F.col("purchase_currency")))
