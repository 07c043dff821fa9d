"""Named queries: a Spark plan over the test tables and, where one exists, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.operators.search import Catalogue
from shelfwise.plans import standins

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Source:
    """The views of one data folder."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return standins.view(self.spark, self.sf_dir, name)

    def catalogue(self, product: str = "product") -> Catalogue:
        return Catalogue(getattr(self, product), self.grape, self.pairing, self.store, self.store_product)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable]:
        """Register a plan under ``name`` with its SQL text (views in braces)."""
        def register(plan: Callable[[Source], DataFrame]) -> Callable:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, sf_dir: plain(plan(Source(spark, sf_dir)))
            if sql is not None:
                self.sql[name] = standins.with_views(sql)
            return plan
        return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types every engine prints alike: flags and integers as BIGINT,
    lists as text joined by '|', timestamps as text."""
    columns = []
    for field in df.schema:
        kind = field.dataType.typeName()
        col = F.col(f"`{field.name}`")
        if kind == "boolean":
            col = col.cast("int").cast("bigint")
        elif kind in ("integer", "short", "byte", "long"):
            col = col.cast("bigint")
        elif kind in ("float", "decimal"):
            col = col.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array":
            col = F.array_join(F.transform(col, lambda x: x.cast("string")), "|")
        columns.append(col.alias(field.name))
    return df.select(*columns)
