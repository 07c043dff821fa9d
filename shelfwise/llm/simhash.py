"""SimHash fingerprints, and all fingerprints within a Hamming radius.

A text's terms are its words (split at ASCII white space, A-Z lower-cased) and its pairs
of neighbouring words, each occurrence counting once. A word weighs its characters beyond
three (one at least), so that the short words all texts share say little; a pair weighs
two. Each term has a 128-bit hash, and each bit of it adds the term's weight to that bit's
votes. A fingerprint's bit is set where the votes for it outweigh those against.

Fingerprints that differ in at most ``radius`` bits agree on some ``blocks - radius`` of
``blocks`` blocks of bits. There is one table per such choice, keyed by the chosen bits; a
pair is reported by the first table in which it agrees, so once.

Cases: null and empty texts have no terms and the fingerprint of zeros. Equal texts have
equal fingerprints. Ties of votes leave a bit at zero. An empty table gives an empty one.

Everything is a DataFrame expression. Two vote counts of 32 bits share a long: a text's
weights sum up to less than its bytes and words, so below 2^32, where each key holds one text.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.ascii import lower_ascii
from shelfwise.sources.scratch import staged

BITS = 128
#: Bits a table's key has at least: enough that tables over many billions of fingerprints have short buckets.
KEY_BITS = 32
_LANES = 0x0000000100000001
_WHITE = r"[\x20\x09-\x0D]+"
_HALVES = ("high", "low")


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, high, low): the fingerprint of each row's text, in two longs. ``keys`` tell rows apart."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _WHITE), "")
    each = texts.select(*keys, words.alias("_all")).select(*keys, "_all", F.posexplode_outer("_all").alias("_at", "_word"))
    each = each.select(*keys, "_word", F.get("_all", F.col("_at") + 1).alias("_next"))
    weight = F.when(F.col("_word").isNull(), 0).otherwise(F.greatest(F.length("_word") - 3, F.lit(1))).cast("long")
    terms = each.select(*keys, weight.alias("_w"), F.when(F.col("_next").isNull(), 0).otherwise(2).cast("long").alias("_v"),
                        *[F.xxhash64(*cols, F.lit(half)).alias(f"_{name}{half}")
                          for half in (0, 1) for name, cols in (("word", ["_word"]), ("pair", ["_word", "_next"]))])
    votes = [F.sum(F.col("_w") * _lanes(f"_word{half}", i) + F.col("_v") * _lanes(f"_pair{half}", i)).alias(f"_{half}_{i}")
             for half in (0, 1) for i in range(32)]
    counted = terms.groupBy(*keys).agg(F.sum(F.col("_w") + F.col("_v")).alias("_total"), *votes)
    return counted.select(*keys, *[_set_bits([F.col(f"_{half}_{i}") for i in range(32)]).alias(name) for half, name in enumerate(_HALVES)])


def _lanes(hashed: str, i: int) -> Column:
    """Bits i and i + 32, at the low ends of the two halves of a long."""
    return F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(_LANES))


def _set_bits(votes: list[Column]) -> Column:
    low = [(i, v.bitwiseAND(F.lit(0xFFFFFFFF))) for i, v in enumerate(votes)]
    high = [(i + 32, F.shiftrightunsigned(v, 32)) for i, v in enumerate(votes)]
    signed = lambda i: (1 << i) - (1 << 64 if i == 63 else 0)
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(v * 2 > F.col("_total"), F.lit(signed(i))).otherwise(F.lit(0)) for i, v in low + high])


def hexadecimal(high: str = "high", low: str = "low") -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, low)]))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """In how many bits two fingerprints differ."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)])


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The cosine that the differing bits stand for, 0 where it is negative: 1 for equal fingerprints, about 0 for unrelated texts."""
    d = distance(a, b)
    return F.when(d * 2 >= BITS, F.lit(0.0)).otherwise(F.cos(d * F.lit(math.pi / BITS)))


def tables(radius: int, key_bits: int = KEY_BITS) -> list[tuple[int, int]]:
    """Masks (high, low) of the block tables, with as few blocks as give keys of ``key_bits``."""
    blocks = next(m for m in range(radius + 1, BITS + 1) if (m - radius) * (BITS // m) >= key_bits or m == BITS)
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append((signed(mask >> 64), signed(mask & ((1 << 64) - 1))))
    return masks


def _in_tables(prints: DataFrame, masks: list[tuple[int, int]], side: str) -> DataFrame:
    keys = [F.xxhash64(F.col("high").bitwiseAND(F.lit(h)), F.col("low").bitwiseAND(F.lit(w)), F.lit(t)) for t, (h, w) in enumerate(masks)]
    return prints.select(F.col("high").alias(f"_high{side}"), F.col("low").alias(f"_low{side}"),
                         *[c for c in prints.columns if c not in _HALVES], F.posexplode(F.array(*keys)).alias(f"_table{side}", f"_key{side}"))


def within_radius(asked: DataFrame, prints: DataFrame, radius: int, key_bits: int = KEY_BITS) -> DataFrame:
    """Pairs of an asked fingerprint and one of ``prints`` that differ in at most ``radius`` bits, equal ones too.

    Both have high and low, distinct; ``prints`` may have further columns, which come along.
    Gives high, low, near_high, near_low, distance and those columns.
    """
    masks = tables(radius, key_bits)
    left = _in_tables(asked.select(*_HALVES), masks, "1")
    right = _in_tables(prints, masks, "2")
    apart = [F.col(f"_{c}1").bitwiseXOR(F.col(f"_{c}2")) for c in _HALVES]
    agree = [apart[0].bitwiseAND(F.lit(h)).bitwiseOR(apart[1].bitwiseAND(F.lit(w))) == 0 for h, w in masks]
    first = functools.reduce(lambda c, t: c.when(agree[t], t), range(1, len(masks)), F.when(agree[0], 0))
    apart_bits = distance(("_high1", "_low1"), ("_high2", "_low2"))
    met = left.join(right, (F.col("_key1") == F.col("_key2")) & (F.col("_table1") == F.col("_table2"))
                    & (apart_bits <= radius) & (first == F.col("_table1")))
    more = [c for c in prints.columns if c not in _HALVES]
    return met.select(F.col("_high1").alias("high"), F.col("_low1").alias("low"), F.col("_high2").alias("near_high"),
                      F.col("_low2").alias("near_low"), apart_bits.alias("distance"), *more)


def document_key(key: str, text: str) -> Column:
    """A row's id and its text's digest; rows that agree in both are one document."""
    return F.struct(F.col(key).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha"))


def in_ring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n_chars, before, after) of each distinct document; before and after are structs (k, n_chars).

    Documents follow each other by ascending id (nulls first), those of one id by their
    texts' digests; the first comes after the last. Rows are ordered by ranges, and one
    row per range carries the neighbours across.
    """
    distinct = docs.select(document_key(key, text).alias("k"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).distinct()
    ordered = staged(distinct.repartitionByRange("k").withColumn("block", F.spark_partition_id()), "ring")
    own = F.struct("k", "n_chars")
    ends = ordered.groupBy("block").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    along = Window.orderBy("block")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    across = ends.select("block", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("_first"),
                         F.coalesce(F.lag("last").over(along), F.last("last").over(whole)).alias("_last"))
    inside = Window.partitionBy("block").orderBy("k")
    stepped = ordered.withColumns({"_after": F.lead(own).over(inside), "_before": F.lag(own).over(inside)}).join(across, "block")
    return stepped.select("k", "n_chars", F.coalesce("_before", "_last").alias("before"), F.coalesce("_after", "_first").alias("after"))


def edited_texts(docs: DataFrame, ring: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, text, edited): the last quarter of each distinct document replaced by the beginning of the one after it."""
    texts = docs.select(document_key(key, text).alias("k"), F.coalesce(text, F.lit("")).alias("text")).groupBy("k").agg(F.first("text").alias("text"))
    quarter = lambda n: F.floor(n / 4).cast("int")
    given = (texts.join(ring.select("k", "before"), "k")
             .select(F.col("before.k").alias("k"), F.substring("text", F.lit(1), quarter(F.col("before.n_chars"))).alias("given")))
    length = F.length("text")
    return texts.join(given, "k").select(
        "k", "text", F.concat(F.substring("text", F.lit(1), length - quarter(length)), "given").alias("edited"))


def near_edited(docs: DataFrame, asked: Column, key: str = "doc_id", text: str = "text", radius: int = 6) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near.

    n_near is given for rows where ``asked`` holds: how many rows, itself included, have a
    fingerprint within ``radius`` bits, found through the block tables.
    """
    ring = staged(in_ring(docs, key, text), "ring")
    pair = edited_texts(docs, ring, key, text).select("k", F.explode(F.array(*[
        F.struct(F.lit(edited).alias("edited"), F.col(c).alias("text")) for edited, c in ((False, "text"), (True, "edited"))])).alias("one"))
    texts = pair.select("k", "one.edited", "one.text", F.sha2("one.text", 256).alias("sha256"))
    prints = staged(fingerprints(texts, ["k", "edited", "sha256"], "text"), "fingerprints")
    own = prints.filter("not edited").select("k", *_HALVES)
    edited = prints.filter("edited").select("k", F.col("sha256").alias("edited_sha256"), F.col("high").alias("_eh"), F.col("low").alias("_el"))
    following = own.select(F.col("k").alias("_after"), F.col("high").alias("_nh"), F.col("low").alias("_nl"))
    judged = (own.join(edited, "k").join(ring.select("k", F.col("after.k").alias("_after")), "k").join(following, "_after")
              .select("k", *_HALVES, "edited_sha256", hexadecimal().alias("fingerprint"), hexadecimal("_eh", "_el").alias("edited_fingerprint"),
                      likeness(_HALVES, ("_eh", "_el")).alias("near_edited"), likeness(_HALVES, ("_nh", "_nl")).alias("near_next")))
    rows = docs.select(F.col(key), document_key(key, text).alias("k"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
                       F.coalesce(asked, F.lit(False)).alias("_asked"))
    held = staged(rows.join(judged, "k").drop("k"), "judged")
    counted = held.groupBy(*_HALVES).agg(F.count("*").alias("_rows"), F.max("_asked").alias("_any"))
    near = (within_radius(counted.filter("_any"), counted.select(*_HALVES, "_rows"), radius)
            .groupBy(*_HALVES).agg(F.sum("_rows").alias("_near")))
    return held.join(near, [*_HALVES], "left").select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(F.col("_asked"), F.col("_near")).alias("n_near"))
