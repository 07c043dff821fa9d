"""Operators that compare texts or vectors with each other, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import contaminated, cut, near_copies
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import decontaminate, jaccard, nearest, sorted_buckets, suffix_dedup
from shelfwise.llm.components import connected
from shelfwise.llm.fm_index import FMIndex
from shelfwise.llm.jaccard import NGramJaccard
from shelfwise.llm.nearest import Plan
from shelfwise.llm.queries import QUERIES, SQL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=8))
def test_fm_index_finds_every_place(symbols, phrases):
    sequence = np.array([*symbols, 0])
    table = np.zeros((len(phrases), 4), np.int64)
    for row, phrase in zip(table, phrases):
        row[:len(phrase)] = phrase
    number, place = FMIndex(sequence, 5).find(table, np.array([len(p) for p in phrases]))
    expected = {(k, i) for k, p in enumerate(phrases) for i in range(len(sequence)) if sequence[i:i + len(p)].tolist() == p}
    assert len(number) == len(expected) and set(zip(number.tolist(), place.tolist())) == expected


@pytest.mark.parametrize("slice_bytes", [1 << 24, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE", slice_bytes)
    monkeypatch.setattr(decontaminate, "SHARD", 3000)
    rng = random.Random(2)
    vocabulary = ["the", "of", "Été", "x1", "and", "naïve", "42"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.choice([3, 4, 5, 9]))) for i in range(12)] + [(10, "Solo!"), (None, "the of"), (13, None), (14, "..."), (3, phrase(6))]
    texts = ["", None, "SOLO", "solo-the", items[0][1].upper().replace(" ", "--")] + [
        " ".join(rng.choice([*vocabulary, "foreign", "wörd"]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    texts += [texts[-1], "foreign " * 200 + items[1][1], items[2][1] + " zzz " + items[2][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.with_contamination(docs, benchmark, n=4).collect()}
    known = [(i, t) for i, t in items if i is not None and t is not None]
    for i, text in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == contaminated(text, known, 4), text
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
    assert decontaminate.with_contamination(docs.limit(0), benchmark).count() == 0
    assert {r["n_hit"] for r in decontaminate.with_contamination(docs, benchmark.limit(0)).collect()} == {0}


def test_items_without_id_contaminate(spark, tmp_path):
    """In the query and in the pipeline's stage they hit words; ids are counted of the others only."""
    items = [(None, "one two three four five"), (7, "three four five six"), (None, None), (None, "...")]
    texts = ["say one two three four five now", "three four five six", "nothing of it", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    named = [(i, t) for i, t in items if i is not None]
    rows = QUERIES["op1_decontamination"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, rows)) == sorted(con.execute(SQL["op1_decontamination"]).fetchall())
    for r in rows:
        n_words, n_hit, _, _, bad = contaminated(texts[r["doc_id"]], items, 13)
        _, _, n_items, digest, _ = contaminated(texts[r["doc_id"]], named, 13)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n_words, n_hit, n_items, digest, bad)
    assert {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()} == {2, 3}


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(500, i) for i in range(400, 450)] + [(i, i + 1) for i in range(600, 640)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in out} == {(x, find(x)) for x in root} and len(out) == len(root)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("frequent", [100, 3])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, frequent):
    """With a low bound for frequent members the lists' pivots and blocks do the work."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    rng = random.Random(frequent)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 30))
    texts = ["", None, "  \t", "one", "ONE", "one two", "x y z w", "x y z w v"]
    for size in (40, 90):
        base = [word() for _ in range(size)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy[: size - rng.choice([0, 0, 0, 2])]))
    line = " ".join(word() for _ in range(12))
    texts += [line + " " + " ".join(word() for _ in range(rng.choice([5, 30]))) for _ in range(40)]
    texts += texts[20:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    for n, share in ((4, 85), (2, 60)):
        out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NGramJaccard(n, share).join(docs).collect()}
        assert [out[i] for i in range(len(texts))] == near_copies(texts, n, share)


def test_jaccard_join_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t"), (5, "")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"]) for r in NGramJaccard(4, 85).join(docs).collect()), key=repr)
    assert out == sorted([(None, 7), (7, 7), (7, 7), (None, None), (5, 5)], key=repr)
    assert NGramJaccard().join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length, bucket", [(40, 400_000), (40, 60), (13, 150)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, length, bucket):
    """Small buckets make tokens straddle their boundaries."""
    monkeypatch.setattr(sorted_buckets, "BUCKET", bucket)
    rng = random.Random(length + bucket)
    noise = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = ["", None, "a" * 300, "ab" * 100, "short"]
    for _ in range(60):
        parts = [noise(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a:a + rng.randint(length // 2, len(p))], noise(rng.randint(0, 60))]
        texts.append("".join(parts))
    texts += [noise(200, "ab") for _ in range(5)] + texts[10:13] * 2
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    out = suffix_dedup.with_spans(docs, length=length, keep_text=True).collect()
    expected = dict(zip(texts, cut([(t or "").encode() for t in texts], length)))
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"]) == expected[r["text"]]
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
    assert suffix_dedup.with_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words, bucket", [(51, 400_000), (7, 40), (2, 60)])
def test_suffix_dedup_by_words_equals_brute_force(spark, monkeypatch, words, bucket):
    """Long and short words, any white space between them; bytes as before beside them."""
    monkeypatch.setattr(sorted_buckets, "BUCKET", bucket)
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdé.") for _ in range(rng.choice([1, 1, 2, 9])))
    passages = [[word() for _ in range(n)] for n in (words - 1, words, words + 1, 3 * words)]
    texts = ["", None, "a " * 300, " \n", "x" * 900, "x" * 900 + "y"]
    for _ in range(50):
        parts = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += p[a:a + rng.randint(words // 2, len(p))] + [f"only{rng.random()}"]
        texts.append("".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in parts))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, word_cut string")
    out = suffix_dedup.with_spans(docs, keep_text=True, words=words).collect()
    assert len(out) == len(texts)
    places = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    windows = Counter(tuple(w for *_, w in own[i:i + words]) for own in places for i in range(len(own) - words + 1))
    long = Counter(t[i:i + 400] for t in ((t or "").encode() for t in texts) for i in range(len(t) - 399))
    for r in out:
        data, own = (r["text"] or "").encode(), places[r["doc_id"]]
        gone = np.zeros(len(data), bool)
        for i in range(len(own) - words + 1):
            if windows[tuple(w for *_, w in own[i:i + words])] > 1:
                gone[own[i][0]:own[i + words - 1][1]] = True
        for i in range(len(data) - 399):
            if long[data[i:i + 400]] > 1:
                gone[i:i + 400] = True
        assert r["kept"] == bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
        assert r["n_removed"] == gone.sum() == sum(s["end"] - s["first"] for s in r["spans"])


def test_pipeline_cuts_a_passage_of_51_short_words(spark):
    """Of under 400 bytes, in two documents that are otherwise different."""
    passage = " ".join(f"w{i}" for i in range(51))
    texts = ["Here begins one text. " + passage + " and so it ends", "Another one\n" + passage + "\nhas other words", "A third " + passage[:-4]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    kept = [t.replace(passage, "") for t in texts]
    assert len(passage) < 400 and out == {i: (t, len(t)) for i, t in enumerate(kept)}


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, 16)).astype(np.float32)
    vectors[500:520] = vectors[499]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15 + [None]), (1004, [1.0, 2.0]), (1005, []), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    small = Plan(list_size=20, sample=400, trials=60, least_seen=40, block_rows=16, block_queries=2, columns=4)
    found = {}
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, plan=small).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, own in found.items():
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        own.sort()
        assert [x[0] for x in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert np.allclose([x[1] for x in own], d[[x[2] for x in own]], atol=1e-12)
        hits += len(set(best) & {x[2] for x in own})
    assert hits / (10 * len(found)) >= 0.9
    few = nearest.search(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0
