"""Predicates over the product table. Each is a filter or a semi/anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise import spec
from shelfwise.functions.strings import any_contains
from shelfwise.functions.text import Term, match_text


def having(df: DataFrame, child: DataFrame, key: str, col: str, value) -> DataFrame:
    """Rows with at least one child row of that value (EXISTS).

    The child side is reduced to distinct keys first: that shuffle is by the join
    key and is reused by the join, and a key with many child rows becomes one row.
    """
    keys = child.filter(F.col(col) == value).select(F.col(key).alias("_child_key")).distinct()
    return df.join(keys, F.col(key) == F.col("_child_key"), "left_semi")


def having_not(df: DataFrame, child: DataFrame, key: str, col: str, value) -> DataFrame:
    """Rows with no child row of that value (NOT EXISTS); a NULL key is kept."""
    keys = child.filter(F.col(col) == value).select(F.col(key).alias("_child_key")).distinct()
    return df.join(keys, F.col(key) == F.col("_child_key"), "left_anti")


def common_filters(df: DataFrame, max_rank: int = 1, category: str | None = None, country: str | None = None,
                   min_price: float | None = None, max_price: float | None = None,
                   store_id=None, store_product: DataFrame | None = None) -> DataFrame:
    """The filters every listing shares. Plain columns first, so they reach the scan."""
    out = df.filter((F.col("availability_rank") <= max_rank) & ~F.col("is_discontinued"))
    if category is not None:
        out = out.filter((F.col("cat1") == category) | (F.col("cat2") == category))
    if country is not None:
        out = out.filter(F.col("country") == country)
    if min_price is not None:
        out = out.filter(F.col("price") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("price") <= max_price)
    if store_id is not None:
        out = having(out, store_product, "product_id", "site_id", store_id)
    return out


def name_match(df: DataFrame, text: str, columns: tuple[str, ...] = ("full_name", "producer")) -> DataFrame:
    """Text contained in the name or the producer, ignoring case."""
    return df.filter(any_contains(list(columns), text))


def clock_range(df: DataFrame, min_body: int | None = None, max_body: int | None = None,
                min_tannin: int | None = None, max_tannin: int | None = None,
                max_sweetness: int | None = None, min_fruitacid: int | None = None) -> DataFrame:
    """Inclusive bounds on taste clocks; an absent clock never matches a bound."""
    bounds = (
        ("clock_body", ">=", min_body), ("clock_body", "<=", max_body),
        ("clock_tannin", ">=", min_tannin), ("clock_tannin", "<=", max_tannin),
        ("clock_sweetness", "<=", max_sweetness), ("clock_fruitacid", ">=", min_fruitacid),
    )
    for clock, side, bound in bounds:
        if bound is not None:
            df = df.filter(F.col(clock) >= bound if side == ">=" else F.col(clock) <= bound)
    return df


def dietary(df: DataFrame, organic: bool = False, vegan: bool = False, natural: bool = False,
            gluten_free: bool = False, kosher: bool = False) -> DataFrame:
    """Only products known to have the attribute: not enriched is not a yes."""
    wanted = {"is_organic": organic, "is_vegan": vegan, "is_natural": natural,
              "is_gluten_free": gluten_free, "is_kosher": kosher}
    for column, on in wanted.items():
        if on:
            df = df.filter(F.col(column))
    return df


def list_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The narrow listing projection."""
    return df.select(*spec.LIST_COLUMNS, *extra)


def rated_only(df: DataFrame) -> DataFrame:
    """Rated products: a real rating has a body of at least 1."""
    return df.filter(F.col("clock_body") > 0)


# What people call a style -> grapes (all required), countries, words not in the note.
STYLE_PRESETS = {
    "Burgundy": (("Pinot noir",), ("Frankrike",), None),
    "Bordeaux": (("Cabernet sauvignon", "Merlot"), (), None),
    "Rioja": (("Tempranillo",), ("Spanien",), None),
    "Barolo": (("Nebbiolo",), ("Italien",), None),
    "Chablis": (("Chardonnay",), (), "ek"),
    "New World Shiraz": (("Syrah",), ("Australien", "Sydafrika"), None),
}


def style_preset(df: DataFrame, grapes: DataFrame, name: str,
                 presets: dict[str, tuple] = STYLE_PRESETS, key: str = "product_id") -> DataFrame:
    """Products of a named style: all its grapes, one of its countries, its note rule."""
    required, countries, unwanted = presets[name]
    out = df
    if countries:
        out = out.filter(F.col("country").isin(*countries))
    if unwanted:
        out = out.filter(~match_text(Term(unwanted), ("taste",)))
    for grape in required:
        out = having(out, grapes, key, "grape", grape)
    return out


def styles_of(df: DataFrame, grapes: DataFrame, presets: dict[str, tuple] = STYLE_PRESETS,
              key: str = "product_id") -> DataFrame:
    """(key, style) for every preset a product satisfies, all presets in one pass over the grapes.

    The presets are a small constant: they become conditional aggregates over the
    grape table, joined back to the products once.
    """
    names = sorted({g for required, _, _ in presets.values() for g in required})
    flags = grapes.filter(F.col("grape").isin(*names)).groupBy(F.col(key).alias("_gkey")).agg(
        *[F.max(F.col("grape") == g).alias(f"_g{i}") for i, g in enumerate(names)])
    joined = df.join(flags, F.col(key) == F.col("_gkey"))
    labels = []
    for style, (required, countries, unwanted) in presets.items():
        ok: Column = F.lit(True)
        for g in required:
            ok = ok & F.col(f"_g{names.index(g)}")
        if countries:
            ok = ok & F.coalesce(F.col("country").isin(*countries), F.lit(False))
        if unwanted:
            ok = ok & ~match_text(Term(unwanted), ("taste",))
        labels.append(F.when(ok, F.lit(style)))
    return joined.select(key, F.explode(F.array_compact(F.array(*labels))).alias("style"))
