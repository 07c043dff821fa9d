"""Ordinary words for taste, price and sugar as multi-label columns.

The bands overlap by design, so each function returns an array of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Clock column -> (label, lowest, highest), bounds inclusive.
TASTE_BANDS = (
    ("clock_body", "light", None, 6),
    ("clock_body", "medium", 6, 8),
    ("clock_body", "full-bodied", 9, None),
    ("clock_tannin", "smooth", None, 4),
    ("clock_tannin", "some structure", 5, 7),
    ("clock_tannin", "structured", 8, None),
    ("clock_sweetness", "dry", None, 2),
    ("clock_sweetness", "off-dry", 3, 6),
    ("clock_sweetness", "sweet", 7, None),
    ("clock_fruitacid", "fresh", 8, None),
    ("clock_fruitacid", "soft", None, 5),
    ("clock_smokiness", "smoky", 7, None),
    ("clock_bitter", "bitter", 8, None),
)

# Price of 750 ml -> band, upper bound exclusive.
BUDGET_BANDS = (("everyday", None, 100), ("sweet spot", 100, 200), ("occasion", 200, 400), ("splurge", 400, None))

# Residual sugar in g/l -> (label, low, low inclusive, high, high inclusive).
DOSAGE_BANDS = (
    ("Brut Nature", None, True, 3.0, False),
    ("Extra Brut", 0.0, True, 6.0, True),
    ("Brut", None, True, 12.0, False),
    ("Extra Dry", 12.0, True, 17.0, True),
    ("Sec", 17.0, True, 32.0, True),
    ("Demi-Sec", 32.0, True, 50.0, True),
    ("Doux", 50.0, False, None, True),
)


def _between(c: Column, low, high) -> Column:
    inside = c.isNotNull()
    if low is not None:
        inside = inside & (c >= low)
    if high is not None:
        inside = inside & (c <= high)
    return inside


def _labels(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in pairs]))


def taste_bands(columns: dict[str, str] | None = None) -> Column:
    """Labels of every band the clocks fall into; ``columns`` renames clock columns."""
    names = columns or {}
    return _labels([
        (label, _between(F.col(names.get(clock, clock)), low, high)) for clock, label, low, high in TASTE_BANDS
        if columns is None or clock in columns
    ])


def budget_band(price: Column) -> Column:
    """One label; NULL for an unknown price."""
    band = F.lit(None).cast("string")
    for label, low, high in reversed(BUDGET_BANDS):
        inside = price.isNotNull()
        if low is not None:
            inside = inside & (price >= low)
        if high is not None:
            inside = inside & (price < high)
        band = F.when(inside, F.lit(label)).otherwise(band)
    return band


def dosage_bands(sugar_g_l: Column) -> Column:
    """Labels a sugar content may carry; the ranges overlap."""
    pairs = []
    for label, low, low_in, high, high_in in DOSAGE_BANDS:
        inside = sugar_g_l.isNotNull()
        if low is not None:
            inside = inside & ((sugar_g_l >= low) if low_in else (sugar_g_l > low))
        if high is not None:
            inside = inside & ((sugar_g_l <= high) if high_in else (sugar_g_l < high))
        pairs.append((label, inside))
    return _labels(pairs)


def rated(clocks: tuple[str, ...] = ("clock_body", "clock_tannin", "clock_sweetness", "clock_fruitacid")) -> Column:
    """False where all four clocks are zero, which is how an unrated product looks.

    A missing clock counts as zero here, so a row with no clock at all is unrated.
    """
    some = F.lit(False)
    for clock in clocks:
        some = some | (F.coalesce(F.col(clock), F.lit(0)) != 0)
    return some
