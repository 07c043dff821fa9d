"""Phrases, source audit and fingerprints against brute force on small rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import phrases, simhash, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def random_rows(seed, n=70):
    rng = random.Random(seed)
    words = ["a", "Bb", "ccc", "é", "Éa", "a-b", "x1", "日本", "\x1cq", "dDd"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[:rng.choice((2, 4, 10))]) + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(rng.choice((0, 1, 3, 20, 60))))
        rows.append((i, text, rng.choice(["en", "en", "en", None, "", "und"]), rng.choice(["s", "s", "t", None, "u v"]), "clash"))
    common = "one two three four five six seven"
    rows += [(100 + i, common + (" eight" if i % 4 else ""), "en", "s", None) for i in range(12)]
    return rows + [(200, None, "en", "t", None), (200, None, "en", "t", None), (None, "a " * 3000, "xx", "alone", None), (None, "", None, None, None)]


# --- phrases ------------------------------------------------------------------

def best_phrases(rows, least, top):
    out = []
    by_lang = defaultdict(list)
    for _, text, lang, *_ in rows:
        by_lang["und" if lang is None else lang] += [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i:i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(len(p) for p in pieces)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        ranked = []
        for g, a in candidates.items():
            if len(g) == 2 and any(100 * b >= 50 * a for h, b in candidates.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, l, r, n, -s) for i, (s, a, g, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("hot_share, held", [(1 / 5000, 4_000_000), (0.05, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, hot_share, held):
    """Also with parts for nearly all words, and with counts put out after every few words."""
    monkeypatch.setattr(phrases, "HOT_SHARE", hot_share)
    monkeypatch.setattr(phrases, "HELD", held)
    rows = random_rows(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=4, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, 4, 40)


def test_paths_join_edges_of_inner_nodes(spark):
    edges = [("en", *"abc", 5), ("en", *"bcd", 5), ("en", *"cde", 5), ("en", *"cdf", 2), ("en", *"xyz", 3)]
    nodes = [("en", "a", "b", 5), ("en", "b", "c", 5), ("en", "c", "d", 7), ("en", "d", "e", 5), ("en", "d", "f", 2), ("en", "x", "y", 4), ("en", "y", "z", 3)]
    got = phrases.paths(spark.createDataFrame(edges, "lang string, first string, second string, third string, f long"),
                        spark.createDataFrame(nodes, "lang string, first string, second string, f long"))
    assert sorted(("".join(r.words), r.f) for r in got.collect()) == [("abcd", 5), ("cde", 5), ("cdf", 2), ("xyz", 3)]


def test_phrase_scores_pass_64_bits(spark):
    a, left, right = 9_999_999_999_999, 10_000_000_000_001, 9_999_999_999_999
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * a * a // (left * right)


def test_no_phrases_in_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


# --- source audit -------------------------------------------------------------

def audited(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, words in docs:
            if x == lang:
                counts[s].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, p in shares.items():
            pairs = [(-sum(f(p[t], p2[t]) for t in kept), o) for o, p2 in shares.items() if o != s]
            terms = [(-f(p[t], q[t]), t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("levels, held", [((3, 6), 4_000_000), ((1, 2, 5), 10), ((), 4_000_000)])
def test_source_audit_equals_brute_force(spark, monkeypatch, levels, held):
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = random_rows(5)
    got = source_audit.divergence(spark.createDataFrame(rows, SCHEMA).repartition(4), min_docs=3, top_terms=4, levels=levels)
    assert sorted(map(tuple, got.collect())) == audited(rows, 3, 4)


def test_discarded_prefixes_are_not_extended(spark):
    texts = ["abcx", "abcy", "abcz", "abd", "q"] * 2
    docs = source_audit.read(spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string"))
    level = source_audit._level(docs, None, 3, 6)
    assert [(r.prefix, r.docs) for r in level.collect()] == [(int.from_bytes(b"abc", "little"), 6)]
    whole = source_audit._whole(docs, (3, source_audit._bitmap(level)))
    assert {r.term for r in whole.collect()} == {"abcx", "abcy", "abcz"}


def test_source_audit_of_an_empty_table(spark):
    assert source_audit.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


# --- fingerprints -------------------------------------------------------------

def printed(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    chain = lambda *parts: _chained(parts)
    votes, total = [0] * 128, 0
    for i, w in enumerate(words):
        terms = [((w,), max(len(w) - 3, 1))] + ([((w, words[i + 1]), 2)] if i + 1 < len(words) else [])
        for parts, weight in terms:
            total += weight
            bits = chain(*parts, 0) << 64 | chain(*parts, 1)
            for b in range(128):
                votes[b] += weight * (bits >> b & 1)
    return sum(1 << b for b in range(128) if 2 * votes[b] > total)


def _chained(parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p.to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def near(a, b):
    d = (a ^ b).bit_count()
    return 0.0 if 2 * d >= 128 else math.cos(d * math.pi / 128)


def test_fingerprints_equal_brute_force(spark):
    rows = random_rows(7) + [(40, "twin", None, None, None), (300, "Some long sentence of quite different words, about pears " * 30, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    got = simhash.near_edited(docs, F.col("doc_id") % 20 == 0).collect()
    distinct = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).digest()))
    expected = {}
    for at, (i, text) in enumerate(distinct):
        after = distinct[(at + 1) % len(distinct)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        own, other = printed(text), printed(edited)
        expected[i, hashlib.sha256(text.encode()).hexdigest()] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{other:032x}",
                                                                  round(near(own, other), 9), round(near(own, printed(after)), 9), own)
    wanted = Counter()
    prints = [expected[i, hashlib.sha256((t or "").encode()).hexdigest()][-1] for i, t, *_ in rows]
    for i, t, *_ in rows:
        *rest, own = expected[i, hashlib.sha256((t or "").encode()).hexdigest()]
        wanted[(i, *rest, sum((own ^ p).bit_count() <= 6 for p in prints) if i is not None and i % 20 == 0 else None)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.n_near) for r in got) == wanted


@pytest.mark.parametrize("radius, key_bits", [(0, 32), (1, 8), (3, 32), (6, 32)])
def test_block_tables_find_all_within_the_radius(spark, radius, key_bits):
    rng = random.Random(radius)
    centre = [rng.getrandbits(128) for _ in range(4)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(9))) for c in centre for _ in range(30)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    df = spark.createDataFrame([(*halves(p), i) for i, p in enumerate(prints)], "high long, low long, place int")
    got = simhash.within_radius(df.filter("place % 2 = 0"), df, radius, key_bits).select("high", "low", "place", "distance").collect()
    want = [(*halves(a), j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.product(enumerate(prints), repeat=2) if i % 2 == 0 and (a ^ b).bit_count() <= radius]
    assert sorted(map(tuple, got)) == sorted(want)


def test_fingerprints_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(20, "abcdefgh")], "doc_id long, text string")
    row = simhash.near_edited(docs, F.col("doc_id") % 20 == 0).first()
    assert (row.edited_sha256, row.near_next, row.n_near) == (hashlib.sha256(b"abcdefab").hexdigest(), 1.0, 1)
    assert simhash.near_edited(docs.filter("false"), F.lit(True)).count() == 0
