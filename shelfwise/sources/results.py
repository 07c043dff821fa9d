"""Writing a query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FORMATS = ("table", "json", "csv")


def write_result(df: DataFrame, path: str, format: str = "table", limit: int | None = None) -> None:
    """Write as Parquet table, JSON lines or CSV with a header, optionally the first rows only."""
    if format not in FORMATS:
        raise ValueError(f"unknown result format {format!r}; one of {FORMATS}")
    out = df if limit is None else df.limit(limit)
    writer = out.write.mode("overwrite")
    if format == "csv":
        nested = [f.name for f in out.schema if f.dataType.typeName() in ("array", "struct", "map")]
        for name in nested:
            out = out.withColumn(name, F.to_json(name))
        out.write.mode("overwrite").option("header", True).csv(path)
    elif format == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
