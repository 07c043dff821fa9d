"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwise.sources.scratch import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the component's smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest
    of them. Minima are partial aggregates, so a node with very many links is no more
    than a skewed join key. Rounds end when nothing changes (about log n of them).
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _print(edges)
    while True:
        edges = staged(_small_star(_large_star(edges)), "links")
        after = _print(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
