"""Where jobs put tables and stream state that other executors must see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. One of this machine's own serves only where Spark itself runs on it alone."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="shelfwise-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_in_pieces(spark: SparkSession) -> Iterator[None]:
    """Wide projections as several methods: the JVM does not compile one beyond 8000 bytes and interprets it for every row."""
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a result several branches of a plan need: it is computed once, later
    stages read only the columns they use, and a lost executor costs a re-read
    instead of the whole lineage.
    """
    path = new_path(df.sparkSession, name)
    with compiled_in_pieces(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
