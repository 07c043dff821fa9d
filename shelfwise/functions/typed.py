"""Defensive typed reads out of a VARIANT column.

A missing or mistyped field becomes NULL (false for flags), never an error and
never a silent conversion: plain ``try_variant_get`` would turn ``"yes"`` into
true and ``42`` into ``'42'``, so each read is guarded by the value's own type.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfwise.functions.strings import strip

NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"
NUMERIC_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"


def _path(field: str) -> str:
    return f"$.{field}"


def _type(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, _path(field), "variant"))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def text(v: Column, field: str) -> Column:
    """The trimmed value of a JSON string, '' for anything else."""
    value = F.when(_type(v, field) == "STRING", F.try_variant_get(v, _path(field), "string"))
    return F.coalesce(strip(value), F.lit(""))


def flag(v: Column, field: str) -> Column:
    """A JSON boolean, false for anything else."""
    value = F.when(_type(v, field) == "BOOLEAN", F.try_variant_get(v, _path(field), "boolean"))
    return F.coalesce(value, F.lit(False))


def number(v: Column, field: str) -> Column:
    """A JSON number, or a string that is exactly a number (no blanks around it)."""
    kind = _type(v, field)
    string = F.try_variant_get(v, _path(field), "string")
    return F.when(kind.rlike(NUMERIC_TYPES), F.try_variant_get(v, _path(field), "double")).when(
        (kind == "STRING") & string.rlike(NUMERIC_TEXT), _finite(string.try_cast("double"))
    )


def integer(v: Column, field: str) -> Column:
    """As ``number``, truncated towards zero."""
    return number(v, field).try_cast("int")


def vintage(v: Column, field: str = "vintage") -> Column:
    """A number truncated, or a string that is an integer after trimming."""
    kind = _type(v, field)
    string = strip(F.try_variant_get(v, _path(field), "string"))
    return F.when(kind.rlike(NUMERIC_TYPES), F.try_variant_get(v, _path(field), "double").try_cast("int")).when(
        (kind == "STRING") & string.rlike(INTEGER_TEXT), string.try_cast("int")
    )


def text_list(v: Column, field: str) -> Column:
    """The strings among a JSON array's elements, NULL when it is no array."""
    items = F.try_variant_get(v, _path(field), "array<variant>")
    strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))


def null_if_empty(c: Column) -> Column:
    """'' means absent for optional text."""
    return F.when(c != "", c)
