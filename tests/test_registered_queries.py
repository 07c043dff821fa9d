"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from shelfwise.plans import all_registries

OWN = {name for registry in all_registries() for name in registry.queries}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    difference = compare.compare(df, con, SQL[name]) if name in SQL else None
    # The smallest tables leave a few selective queries without rows.
    assert difference in (None, "both results are empty"), difference


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["product_id", "full_name", "price", "volume_ml", "sek_per_l"]


def test_every_query_has_sql():
    assert OWN <= set(SQL)
