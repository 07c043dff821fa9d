"""Publishing tables as versions: written whole, judged by the gate, then named in a log that readers follow.

A version is a folder of tables that never changes. The log is a folder with one
file per published version; a file appears at once or not at all, so a reader sees
the version before or the one after, never half of one. A reader resolves the log
once and stays with the folder it found, whatever is published meanwhile.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise import spec
from shelfwise.operators.audit import publish_gate

_LOG = "number long, folder string, products long"
VERDICT = "products long, live long, publish boolean, reason string, number long"


@dataclass(frozen=True)
class Version:
    """One published version, as a reader found it."""

    spark: SparkSession
    number: int
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def published(spark: SparkSession, root: str) -> DataFrame:
    """number, folder, products of every published version; empty below a ``root`` where nothing was published yet."""
    spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{root}/log")
    return spark.read.schema(_LOG).parquet(f"{root}/log")


def live(spark: SparkSession, root: str) -> Version | None:
    """The latest version, or None."""
    last = published(spark, root).agg(F.max_by(F.struct("number", "folder"), F.struct("number", "folder")).alias("last")).first().last
    return last and Version(spark, last.number, last.folder)


def publish(root: str, tables: dict[str, DataFrame], judged: str = "product", minimum: int = spec.MIN_PUBLISH_ROWS) -> DataFrame:
    """Write ``tables`` as a version and name it in the log if the gate lets it pass: (products, live, publish, reason, number).

    The gate counts what was written, not the plans it came from, and compares the table
    ``judged`` with the live version's. A refused version stays in its folder, unnamed, for whoever asks why; number is
    the version that readers get afterwards (NULL if none). One publisher at a time; a
    publisher that is lost before its log entry has changed nothing and may run again.
    """
    spark = tables[judged].sparkSession
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    return release(spark, root, folder, judged, minimum)


def release(spark: SparkSession, root: str, folder: str, judged: str = "product", minimum: int = spec.MIN_PUBLISH_ROWS) -> DataFrame:
    """The second half of ``publish``, for tables already written to ``folder``; a folder that the log names is not named again."""
    named = published(spark, root).filter(F.col("folder") == folder).orderBy("number").first()
    if named:
        last = published(spark, root).filter(F.col("number") < named.number).orderBy(F.desc("number")).first()
        return spark.createDataFrame([(named.products, last.products if last else 0, True, None, named.number)], VERDICT)
    before = live(spark, root)
    verdict = publish_gate(spark.read.parquet(f"{folder}/{judged}"), before and before.table(judged), minimum).first()
    number = before.number if before else None
    if verdict.publish:
        number = (number or 0) + 1
        entry = spark.createDataFrame([(number, folder, verdict.products)], _LOG).coalesce(1)
        entry.write.mode("append").parquet(f"{root}/log")
    return spark.createDataFrame([(*verdict, number)], VERDICT)


def roll_back(spark: SparkSession, root: str, number: int) -> int:
    """Serve the tables of version ``number`` again, under a number of their own, which is returned."""
    row = published(spark, root).filter(F.col("number") == number).first()
    if row is None:
        raise ValueError(f"no published version {number}")
    new = live(spark, root).number + 1
    spark.createDataFrame([(new, row.folder, row.products)], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return new
