"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the
shared folder and reads it again as the next stage's ``docs``. All but the last return
the columns of documents. Rows whose id is null or repeated pass through like others:
a row is told from others by its id and text together. Columns that a stage does not
read travel as one struct, so that no name of theirs can clash with an operator's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.llm import decontaminate, packing, quality, suffix_dedup
from shelfwise.llm.jaccard import NGramJaccard
from shelfwise.sources.scratch import staged


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as the struct ``others``, every column but the text."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others"))


def _together(apart: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The documents of ``_apart`` again, with columns ``changed`` in place of the old ones."""
    old = lambda c: F.col("text") if c == "text" else F.col("others")[c]
    return apart.select(*(changed.get(c, old(c)).alias(c) for c in columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(quality.with_scores(_apart(docs), model).filter("predicted = 1"), docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by 5-gram Jaccard similarity of 0.8 or more, the one with the smallest id stays."""
    named = _apart(docs).withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("d"), F.octet_length("text").alias("n")))
    joined = staged(NGramJaccard(n=5, share=80).join(named, key="_row"), "near-copies")
    counted = joined.groupBy("_row").agg(F.count("*").alias("rows"), F.first("class").alias("class"), F.min("component_id").alias("kept_row"))
    gone = counted.filter("class is not null and _row <> kept_row").select("_row")
    repeated = counted.filter("class is not null and _row = kept_row and rows > 1").select("_row")
    stays = named.join(gone, "_row", "left_anti")
    one = stays.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return _together(stays.join(repeated, "_row", "left_anti").unionByName(one), docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes or more, that occur elsewhere are cut out; a document of which nothing stays goes."""
    cut = suffix_dedup.with_spans(_apart(docs), keep_text=True, words=51).filter("kept <> '' or n_removed = 0")
    less = F.col("n_removed") > 0
    return _together(cut, docs.columns, text=F.when(less, F.col("kept")).otherwise(F.col("text")),
                     n_chars=F.when(less, F.length("kept").cast("long")).otherwise(F.col("others")["n_chars"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words occur in benchmark items go."""
    judged = decontaminate.with_contamination(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed_items=True)
    return _together(judged.filter("not contaminated"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_near_copies), ("suffix-array dedup", without_repeats),
          ("benchmark decontamination", without_benchmark), ("packing", packed)]

#: Compressed sizes and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
