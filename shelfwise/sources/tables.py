"""The typed mirror on disk, laid out so that a merge rewrites touched buckets only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket a key belongs to: a pure function of the key, so a row never moves."""
    return F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, keys: list[str], buckets: int, sort: tuple[str, ...] = ()) -> None:
    """Write (or rewrite) the buckets present in ``df``; buckets not present stay as they are.

    Rows are shuffled once, by bucket. A rebalance rather than a repartition: an
    oversized bucket (one key owning much of a child table) is split over several
    tasks and files. Rows are sorted so that Parquet's min/max statistics skip
    row groups.
    """
    keyed = df.withColumn(BUCKET, bucket_of(keys, buckets))
    placed = keyed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *(sort or keys))
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with its bucket column, on which a filter prunes folders."""
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
