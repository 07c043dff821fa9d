"""Row-level rules of the cellar: drinking windows, locations, partial dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfwise import spec
from shelfwise.functions.strings import strip


def window_ready(frm: Column, until: Column, year: int) -> Column:
    some = frm.isNotNull() | until.isNotNull()
    return some & (F.coalesce(frm, F.lit(0)) <= year) & (F.coalesce(until, F.lit(9999)) >= year)


def window_soon(until: Column, year: int) -> Column:
    """Includes wines already past their window: those are the most urgent."""
    return F.coalesce(until <= year + 1, F.lit(False))


def window_not_yet(frm: Column, year: int) -> Column:
    return F.coalesce(frm > year, F.lit(False))


def window_unknown(frm: Column, until: Column) -> Column:
    return frm.isNull() & until.isNull()


def drink_window(kind: str, frm: Column, until: Column, year: int) -> Column:
    """One of the four overlapping window filters."""
    if kind == "ready":
        return window_ready(frm, until, year)
    if kind == "drink_soon":
        return window_soon(until, year)
    if kind == "not_yet":
        return window_not_yet(frm, year)
    if kind == "unknown":
        return window_unknown(frm, until)
    raise ValueError(f"unknown drink window {kind!r}; one of {spec.DRINK_WINDOWS}")


def window_state(frm: Column, until: Column, year: int) -> Column:
    """One label, first match; NULL without bounds."""
    return (
        F.when(window_unknown(frm, until), F.lit(None).cast("string"))
        .when(until < year, F.lit("past its window"))
        .when(frm > year, F.lit("not ready yet"))
        .when(until <= year + 1, F.lit("ready, drink soon"))
        .otherwise(F.lit("ready"))
    )


def is_slot(part: Column) -> Column:
    return part.rlike(spec.SLOT_PATTERN)


def location_parts(location: Column) -> Column:
    """'B3, c4 , fridge' -> ['B3', 'C4', 'fridge']; slots upper-cased, other text as written."""
    parts = F.transform(F.split(F.coalesce(location, F.lit("")), ","), lambda p: strip(p))
    filled = F.filter(parts, lambda p: p != "")
    return F.transform(filled, lambda p: F.when(is_slot(F.upper(p)), F.upper(p)).otherwise(p))


def slots_in(location: Column) -> Column:
    return F.filter(location_parts(location), is_slot)


def valid_partial_date(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; NULL is fine."""
    return F.coalesce(c.rlike(spec.PARTIAL_DATE_PATTERN), F.lit(True))


def normal_currency(c: Column) -> Column:
    return F.upper(strip(c))


def wine_label(wine_id: Column, producer: Column, name: Column, vintage: Column) -> Column:
    """'#7 Producer Name 2012', with NV where there is no vintage."""
    words = F.concat_ws(" ", F.when(producer != "", producer), name,
                        F.coalesce(vintage.cast("string"), F.lit("NV")))
    return F.concat(F.lit("#"), wine_id.cast("string"), F.lit(" "), words)
