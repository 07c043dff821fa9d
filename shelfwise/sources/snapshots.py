"""Dated raw snapshots: one JSON record per line, one folder or file per UTC day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The day of a file: its folder is called day=..., or its own name has one. Folders further up do not count.
DAY_OF_FILE = r"(?:/day=(\d{4}-\d{2}-\d{2})/[^/]*|/[^/]*?(\d{4}-\d{2}-\d{2})[^/]*)$"


def _with_day(lines: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    day = F.coalesce(*[F.nullif(F.regexp_extract(path, DAY_OF_FILE, i), F.lit("")) for i in (1, 2)])
    return lines.select(F.col("value").alias("raw"), F.try_to_date(day).alias("day"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(raw, day) of every line.

    Below ``path`` the folders ``day=...`` are partitions: a filter on day opens those
    only. Where there are none the day comes from each file's name.
    """
    lines = spark.read.text(path)
    if "day" not in lines.columns:
        return _with_day(lines).filter(F.col("raw") != "")
    return lines.select(F.col("value").alias("raw"), F.col("day").cast("date").alias("day")).filter(F.col("raw") != "")


def stream_snapshot(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as a stream of newly arriving files."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).format("text").load(path)
    return _with_day(lines).filter(F.col("raw") != "")


def write_snapshot(df: DataFrame, path: str, raw: str = "raw", day: str | Column = "day") -> None:
    """Write raw lines below ``path/day=YYYY-MM-DD``; a second run of a day overwrites that day only.

    Needs the dynamic partition overwrite mode, set here for this write.
    """
    day_col = F.col(day) if isinstance(day, str) else day
    lines = df.select(F.col(raw).alias("value"), F.date_format(day_col, "yyyy-MM-dd").alias("day"))
    (lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").text(path))
