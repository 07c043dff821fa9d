"""An inverted index as a table, for many searches over the same text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.functions.text import _words, tokenise
from shelfwise.sources import tables


def inverted_index(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(term, key, column): one row per document, column and distinct term. No shuffle."""
    def tagged(name: str) -> Column:
        return F.transform(F.array_distinct(tokenise(F.col(name))),
                           lambda t: F.struct(t.alias("term"), F.lit(name).alias("column")))

    parts = [tagged(c) for c in columns]
    return df.select(key, F.explode(F.concat(*parts)).alias("_t")).select("_t.term", key, "_t.column")


def write_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Bucketed by term and sorted by (term, document).

    A lookup reads only its terms' folders and, there, only row groups holding
    them; the bucket of a very frequent term is split over several files.
    """
    key = next(c for c in index.columns if c not in ("term", "column"))
    tables.write_table(index, path, ["term"], buckets, ("term", key))


def read_index(spark: SparkSession, path: str, buckets: int = 256) -> StoredIndex:
    return StoredIndex(tables.read_table(spark, path), buckets)


@dataclass(frozen=True)
class StoredIndex:
    """An index on disk and the number of buckets it was written with."""

    rows: DataFrame
    buckets: int


def _hits(index: DataFrame | StoredIndex, words: list[str], columns: tuple[str, ...] | None) -> DataFrame:
    if isinstance(index, StoredIndex):
        # A constant the optimiser folds, so that it prunes folders.
        places = [F.pmod(F.hash(F.lit(w)), F.lit(index.buckets)).cast("int") for w in words]
        hits = index.rows.filter(F.col(tables.BUCKET).isin(*places) & F.col("term").isin(*words))
    else:
        hits = index.filter(F.col("term").isin(*words))
    return hits.filter(F.col("column").isin(*columns)) if columns else hits


def search_all(index: DataFrame | StoredIndex, key: str, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Keys of documents holding every word of ``text``, possibly in different columns."""
    words = sorted(set(_words(text)))
    found = _hits(index, words, columns).groupBy(key).agg(F.count_distinct("term").alias("_n"))
    return found.filter(F.col("_n") == len(words)).select(key)


def search_any(index: DataFrame | StoredIndex, key: str, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Keys of documents holding at least one word of ``text``."""
    return _hits(index, sorted(set(_words(text))), columns).select(key).distinct()


def search_without(index: DataFrame | StoredIndex, key: str, wanted: str, unwanted: str,
                   columns: tuple[str, ...] | None = None) -> DataFrame:
    """Keys with every wanted and no unwanted word, from one lookup and one aggregate."""
    keep, drop = sorted(set(_words(wanted))), sorted(set(_words(unwanted)))
    hits = _hits(index, sorted({*keep, *drop}), columns).groupBy(key).agg(
        F.count_distinct(F.when(F.col("term").isin(*keep), F.col("term"))).alias("_n"),
        F.count_if(F.col("term").isin(*drop)).alias("_bad"))
    return hits.filter((F.col("_n") == len(keep)) & (F.col("_bad") == 0)).select(key)


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, column, documents)."""
    return index.groupBy("term", "column").agg(F.count(F.lit(1)).alias("documents"))
