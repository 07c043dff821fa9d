"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space; ``F.trim`` removes blanks only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive 'contains', with LIKE's wildcards in ``text`` kept."""
    return c.ilike(f"%{text}%")


def any_contains(columns: list[str], text: str) -> Column:
    """True where at least one column contains the text; NULL columns never do."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(contains_text(F.col(name), text), F.lit(False))
    return found
