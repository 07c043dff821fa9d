"""Callers' columns named like an operator's own, hot and missing ids, and words made to collide."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, sharding, suffix_dedup, url_filter
from shelfwise.llm.jaccard import NGramJaccard
from shelfwise.llm.queries import QUERIES

#: Names that operators give to results or to columns on the way.
CLASHING = ["score", "predicted", "_row", "class", "component_id", "rows", "kept_row", "d", "n_bytes", "cut", "word_cut", "kept", "spans",
            "n_removed", "n_spans", "kept_sha256", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "others", "least", "root"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1], ids=[name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_every_column(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    out = stage(spark, wide, sf_dir)
    assert out.columns == wide.columns
    # The documents that stay, and their texts, are the same without the added columns.
    plain = stage(spark, docs, sf_dir)
    assert sorted(map(repr, out.select(docs.columns).collect())) == sorted(map(repr, plain.collect()))
    for row in out.select("doc_id", *CLASHING).collect():
        assert [row[c] for c in CLASHING] == [f"{c}{row.doc_id}" for c in CLASHING]


def test_columns_of_suffix_dedup_and_url_filters_stay(spark):
    docs = spark.createDataFrame([(1, "x" * 30, "a", "b", "c"), (2, "x" * 30, "a", "b", "c")], "doc_id int, text string, d string, cut string, n_bytes string")
    out = suffix_dedup.with_spans(docs, 20, words=3).orderBy("doc_id").collect()
    assert [(r.d, r.cut, r.n_bytes, r.n_removed) for r in out] == [("a", "b", 30, 30)] * 2
    pages = spark.createDataFrame([(1, "http://a.org/x", "mine")], "page_id int, url string, fitting string")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    row = url_filter.judge_urls(pages, rules).first()
    assert (row.fitting, row.verdict, row.rule) == ("mine", "block", "org/")


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_made_to_collide_differ(spark, n):
    """Two words over two letters, each the other's complement, in the order in which polynomials modulo 2^64 vanish."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in NGramJaccard(n=4, share=85).join(docs).collect()} == {(1, 1), (2, 2)}
    judged = decontaminate.with_contamination(docs, spark.createDataFrame([("i", other)], "item_id string, text string"))
    assert {r.doc_id: r.n_hit for r in judged.collect()} == {1: 0, 2: 1}


HOT = {
    "one id": [(7, f"text {i} " + "x" * (i % 50)) for i in range(1000)] + [(100 + i, "y" * 40) for i in range(2000)],
    "no id and no text": [(None, None)] * 1600,
    "one row many times": [(7, "z" * 500)] * 1000 + [(100 + i, "y" * 40) for i in range(2000)],
    "one long text": [(1, "w" * 5000)] + [(100 + i, "y" * 40) for i in range(3000)],
    "no rows": [],
}


@pytest.mark.parametrize("case", HOT)
def test_shards_stay_even(spark, tmp_path, case):
    docs = spark.createDataFrame(HOT[case], "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op8_virtual_slots"](spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(i), len(t or "") + 1) for i, t in HOT[case])
    loads, slots = {}, {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    if out:
        largest = max(r.size for r in out)
        assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= max(largest, 0.02 * sum(loads.values()) / 16 + 50)


def test_heavy_slots_are_in_the_stored_map(spark, tmp_path):
    rows = [(7, "z" * 500)] * 1000 + [(100 + i, "y" * 40) for i in range(2000)]
    numbered = sharding.in_slots(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).withColumn("n", sharding.row_number_of())
    heavy = sharding.heavy_slots(sharding.slot_loads(numbered))
    dealt = sharding.dealt_out(numbered, heavy, "n")
    sharding.write_map(sharding.first_map(sharding.slot_loads(dealt), 16, heavy), str(tmp_path / "map"))
    stored = sharding.read_map(spark, str(tmp_path / "map"))
    hot = numbered.filter("doc_id = 7").first().virtual_slot
    assert hot in [r.virtual_slot for r in stored.filter("dealt").collect()]
    assert dealt.filter("doc_id = 7").select("virtual_slot").distinct().count() > 500
    sharding.write_map(sharding.grown_map(stored, 17), str(tmp_path / "map"))
    assert sharding.read_map(spark, str(tmp_path / "map")).filter("dealt").count() == stored.filter("dealt").count()
