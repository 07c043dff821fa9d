"""The registered queries against their SQL, and the pipeline's stages against brute force."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import compare
import public_tokenizers
import pytest
from brute import checked_packs, contaminated, cut, cut_both, near_copies
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import quality
from shelfwise.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.compare(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), SQL[name]) is None


def test_all_queries_and_the_pipeline_are_registered():
    known = entry.queries()
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and {*QUERIES, "pipeline"} <= set(known)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup",
                                                            "benchmark decontamination", "packing"]


def test_entry_works_without_this_package():
    """Only a missing package is excused; what the package itself lacks is not."""
    code = ("import sys\nclass Gone:\n    def find_spec(self, name, *_):\n        if name in {gone}:\n"
            "            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "print(len(e.queries()), 'pipeline' in e.queries())")
    run = lambda gone: subprocess.run([sys.executable, "-c", code.format(gone=gone)], cwd=ROOT, capture_output=True, text=True)
    assert run("('shelfwise.llm', 'corpus_pipeline')").stdout.split()[1] == "False"
    assert run("('zstandard',)").returncode != 0


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    """The documents with what real tables have: nulls, empty texts, repeated rows, an extra column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "A text without an id stands here.", "en", "s", 33), (900_001, "", "en", "s", 0)], docs.schema)
    return docs.unionByName(docs.filter("doc_id < 3")).unionByName(odd).withColumn("score", F.lit("clash"))


def test_suffix_dedup_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r["doc_id"], *own) for r, own in zip(rows, cut([(r["text"] or "").encode() for r in rows], 400))]
    got = QUERIES["op7_suffix_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_suffix_dedup_query_cuts_passages_of_over_50_words(spark, sf_dir, tmp_path):
    """Shorter than 400 bytes: the contract's columns leave them, text does not."""
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    passage, short = words(52), words(50)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9_000_000 + i, f"{words(30)} {p} {words(30)}") for i, p in enumerate((passage, passage, short, short, "alone"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    data = [(t or "").encode() for _, t in rows]
    for (doc_id, text), by_bytes, (_, less) in zip(rows, cut(data, 400), cut_both(data, 400, 51)):
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"], r["text"]) == (*by_bytes, less)
    planted = [got[9_000_000 + i] for i in range(5)]
    assert [r["n_removed"] for r in planted] == [0] * 5
    assert [passage in r["text"] for r in planted[:2]] == [False] * 2 and [r["text"] for r in planted[2:]] == [t for _, t in rows[-3:]]


def test_stages_one_after_the_other(spark, sf_dir, documents, tmp_path):
    stages, docs = dict(corpus_pipeline.STAGES), documents
    rows = lambda df: df.select("doc_id", "text", "n_chars", "lang", "source").collect()

    def next_of(name, docs):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    before, docs = rows(docs), next_of("quality classifier", docs)
    model = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stays = model.scores([(r["text"] or "").encode() for r in before]) >= 0.3
    assert sorted(map(repr, rows(docs))) == sorted(repr(r) for r, s in zip(before, stays) if s)

    before, docs = rows(docs), next_of("n-gram Jaccard join", docs)
    groups, after = {}, rows(docs)
    for r, (size, component) in zip(before, near_copies([r["text"] for r in before], 5, 80)):
        groups.setdefault(component if size else ("alone", id(r)), []).append(repr(r))
    left = sorted(map(repr, after))
    assert len(left) == len(groups)
    for own in groups.values():
        found = [r for r in own if r in left]
        assert found
        left.remove(found[0])

    before, docs = rows(docs), next_of("suffix-array dedup", docs)
    expected = []
    for r, (removed, kept) in zip(before, cut_both([(r["text"] or "").encode() for r in before], 400, 51)):
        if not removed:
            expected.append(repr((r["doc_id"], r["text"], r["n_chars"])))
        elif kept:
            expected.append(repr((r["doc_id"], kept, len(kept))))
    assert sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in rows(docs)) == sorted(expected)

    before, docs = rows(docs), next_of("benchmark decontamination", docs)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(repr, rows(docs))) == sorted(repr(r) for r in before if not contaminated(r["text"], items, 13)[4])
    assert 0 < docs.count() < documents.count()

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known = docs.filter("doc_id is not null")
    packed = stages["packing"](spark, known, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in rows(known)}
    checked_packs(packed, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids, texts, 2048)


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(piece).collect())) == sorted(map(tuple, docs.select(piece).collect()))


def test_stages_on_empty_tables(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
