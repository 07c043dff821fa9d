"""Session defaults shared by tests, bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession

CLUSTER_DEFAULTS = {
    # Run-time re-planning: coalesce small partitions, split skewed join
    # partitions, turn sort-merge joins into broadcasts when the *measured* size
    # of a side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed group of an aggregate or a rebalance is split as well.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Dates and timestamps mean the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    # Wide projections would become methods too long for the JIT; past this size
    # expressions are compiled in pieces instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rewriting a bucket must not touch its neighbours.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "shelfwise", **extra: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    On a cluster leave ``master`` unset and let spark-submit decide; options
    passed as ``extra`` use ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CLUSTER_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
