"""SQL over the catalogue's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Capped:
    """The first rows of a result and a one-row ``meta``: whether there were more."""

    items: DataFrame
    meta: DataFrame


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run one SQL text over the tables, named in braces: ``SELECT ... FROM {product}``.

    The tables live for this query only. All rows are returned; a text that wants
    fewer says so itself.
    """
    return spark.sql(sql, **tables)


def query_capped(spark: SparkSession, sql: str, tables: dict[str, DataFrame], cap: int) -> Capped:
    """As ``query``, for a display of ``cap`` rows at most. Which rows they are is up to the text's ORDER BY."""
    out = query(spark, sql, tables)
    more = out.limit(cap + 1).agg((F.count(F.lit(1)) > cap).alias("capped"))
    return Capped(out.limit(cap), more)
