"""How a language's sources differ in their terms.

Terms are runs of ASCII letters (A-Z lower-cased) and of anything beyond ASCII. A language
keeps the terms that at least ``min_docs`` of its documents hold. They are found by iceberg
refinement: documents are counted per byte prefix, level by level, and a prefix below the
threshold is not extended, since no term below it can reach the threshold either; a shorter
term is its own prefix. What a level leaves goes to the tasks as a bitmap of fixed size over
hashed (lang, prefix); a collision keeps a prefix too many for one level, never drops one,
and the last level counts whole terms.

Each source's and language's kept terms then get smoothed shares in billionths, and
sources are compared by the triangular discrimination of their shares. All numbers are
whole. A term that both of two sources lack adds the same to every such pair, so only terms
that occur are joined: sums over the dense table come from counts of equal shares.

Cases: null text, lang and source are read as ''. Repeated rows are documents of their own.
A lang without kept terms has pairs of value 0 and no terms; a lone source has no pairs.
An empty table gives no rows. A task's memory follows the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.pretokens import portions
from shelfwise.llm.words import mixed, word_places
from shelfwise.llm.workers import ship_code, slices
from shelfwise.sources.scratch import staged

#: Byte lengths of the levels before whole terms; six at most, so that document and prefix fit in one number.
LEVELS = (3, 6)
#: Bits of a level's bitmap (4 MB), whatever the input.
BITMAP_BITS = 25
#: Occurrences a task holds before it counts them and puts the counts out.
HELD = 4_000_000
_SCALE = 1_000_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IN_TERM = np.arange(256) != 32


class _Numbers(dict):
    """Numbers in order of first sight."""

    def __missing__(self, name) -> int:
        self[name] = number = len(self)
        return number


def _prefixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """First bytes of each term as a number; a shorter term is filled with zeros, which no term holds."""
    found = np.zeros(len(starts), np.uint64)
    for i in range(length):
        byte = data[np.minimum(starts + i, len(data) - 1)].astype(np.uint64)
        found |= np.where(lengths > i, byte, np.uint64(0)) << np.uint64(8 * i)
    return found


def _places(langs: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """Bits of (lang by its checksum, prefix) in a level's bitmap."""
    return (mixed(prefixes ^ mixed(langs)) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def _checksums(langs) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, langs), np.uint64, len(langs))


def _within(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(kept: DataFrame) -> np.ndarray:
    """Bits of the (lang, prefix) in ``kept``; at most 2^19 rows of 64 bits reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _checksums(batch.column("lang").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_places(langs, batch.column("prefix").to_numpy().view(np.uint64)))], names=["at"])

    words = (kept.select("lang", "prefix").mapInArrow(place, "at long").groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow())
    bits = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def _portions(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Columns of a few texts at a time; the last column is the text, in letters and spaces."""
    for batch in slices(batches):
        own = [batch.column(c).cast(pa.binary()).to_pylist() for c in columns]
        for a, b in portions(own[-1]):
            yield *(values[a:b] for values in own[:-1]), [t.translate(_LETTERS) for t in own[-1][a:b]]


def _level(docs: DataFrame, before: tuple[int, np.ndarray] | None, length: int, min_docs: int) -> DataFrame:
    """(lang, prefix, docs) of one level: prefixes whose distinct documents reach the threshold."""
    cut = before[0] if before else 0
    held = docs.sparkSession.sparkContext.broadcast(before[1]) if before else None

    def counted(langs: _Numbers, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
        names = pa.array(list(langs), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array((keys >> np.uint64(48)).astype(np.int64))), pa.array((keys & np.uint64((1 << 48) - 1)).view(np.int64)),
                                          pa.array(counts)], names=["lang", "prefix", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, found, held_now = _Numbers(), [], 0
        for own, texts in _portions(batches, "lang", "text"):
            if held_now > HELD or len(langs) > 1 << 15:
                yield from counted(langs, found)
                langs, found, held_now = _Numbers(), [], 0
            data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
            starts, ends = word_places(data, _IN_TERM)
            doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, side="right")
            number = np.fromiter(map(langs.__getitem__, own), np.uint64, len(own))
            prefixes = _prefixes(data, starts, ends - starts, length)
            if held is not None:
                places = _places(_checksums(own)[doc], prefixes & np.uint64((1 << 8 * cut) - 1))
                alive = _within(held.value, places)
                prefixes, doc = prefixes[alive], doc[alive]
            distinct = np.unique(doc.astype(np.uint64) << np.uint64(48) | prefixes)
            doc, prefixes = (distinct >> np.uint64(48)).astype(np.int64), distinct & np.uint64((1 << 48) - 1)
            found.append(number[doc] << np.uint64(48) | prefixes)
            held_now += len(distinct)
        yield from counted(langs, found)

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, prefix long, docs long")
    return staged(partial.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs), f"prefixes-{length}")


def _whole(docs: DataFrame, before: tuple[int, np.ndarray] | None) -> DataFrame:
    """(lang, source, term, docs, n) of the terms whose last prefix was kept, whatever their own count."""
    cut = before[0] if before else 0
    held = docs.sparkSession.sparkContext.broadcast(before[1]) if before else None

    def counted(groups: _Numbers, terms: _Numbers, found: list[np.ndarray], in_docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, np.uint64)]
        keys, n = np.unique(np.concatenate(found or empty), return_counts=True)
        _, n_docs = np.unique(np.concatenate(in_docs or empty), return_counts=True)  # of the same keys
        group, term = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64((1 << 32) - 1)).astype(np.int64)
        names = list(terms)
        if held is not None and len(keys):
            first = np.frombuffer(b"".join([t[:cut].ljust(8, b"\0") for t in names]), "<u8")
            alive = _within(held.value, _places(_checksums([lang for lang, _ in groups])[group], first[term]))
            group, term, n, n_docs = group[alive], term[alive], n[alive], n_docs[alive]
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([text([g[0] for g in groups]).take(pa.array(group)), text([g[1] for g in groups]).take(pa.array(group)),
                                          text(names).take(pa.array(term)), pa.array(n_docs), pa.array(n)], names=["lang", "source", "term", "docs", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, terms, found, in_docs, held_now = _Numbers(), _Numbers(), [], [], 0
        for langs, sources, texts in _portions(batches, "lang", "source", "text"):
            if held_now > HELD:
                yield from counted(groups, terms, found, in_docs)
                groups, terms, found, in_docs, held_now = _Numbers(), _Numbers(), [], [], 0
            for own, text in zip(zip(langs, sources), texts):
                words = text.split()
                number = np.fromiter(map(terms.__getitem__, words), np.uint64, len(words)) | np.uint64(groups[own] << 32)
                found.append(number)
                in_docs.append(np.unique(number))
                held_now += len(words)
        yield from counted(groups, terms, found, in_docs)

    return docs.mapInArrow(count, "lang string, source string, term string, docs long, n long")


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_occurrences(docs: DataFrame, min_docs: int = 10, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, source, term, n): how often each source holds each term that ``min_docs`` documents of its lang hold."""
    if any(not 1 <= length <= 6 for length in levels) or list(levels) != sorted(set(levels)):
        raise ValueError("levels are ascending lengths of one to six bytes")
    ship_code(docs.sparkSession)
    docs, before = read(docs), None
    for length in levels:
        before = length, _bitmap(_level(docs, before, length, min_docs))
    counted = staged(_whole(docs, before).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "whole-terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    return counted.drop("docs").join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """Smoothed share in billionths, in whole numbers beyond 64 bits."""
    wide = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    above, below = (wide(count) + 2) * F.lit(_SCALE).cast("decimal(10,0)"), wide(total) + wide(terms) * 2
    return F.lit(1) + F.call_function("div", above, below)


def difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of shares; squares stay below 2^63."""
    apart = F.col(p) - F.col(q)
    return F.call_function("div", apart * apart, F.col(p) + F.col(q))


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its lang, and its own outstanding terms."""
    found = staged(kept_occurrences(docs, min_docs, levels), "occurrences")
    vocabulary = found.groupBy("lang").agg(F.count_distinct("term").alias("v"))
    of_source = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    sources = staged(
        read(docs).select("lang", "source").distinct().join(vocabulary, "lang", "left").join(of_source, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"),
                F.coalesce("held", F.lit(0)).alias("held"))
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), "total", "v"))), "sources")
    shares = staged(found.join(sources, ["lang", "source"]).select("lang", "source", "term", "n", "v", share("n", "total", "v").alias("p"), "p0"), "shares")
    return _pairs(shares, sources).unionByName(_outstanding(shares, sources, top_terms))


def _side(df: DataFrame, i: int, shared: tuple[str, ...]) -> DataFrame:
    return df.select(*shared, *[F.col(c).alias(f"{c}{i}") for c in df.columns if c not in shared])


def _pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    # What terms of both add beyond what each of them adds against a source without the term.
    slim = shares.select("lang", "term", "source", "p", "p0")
    both = (_side(slim, 1, ("lang", "term")).join(_side(slim, 2, ("lang", "term")), ["lang", "term"]).filter("source1 < source2")
            .groupBy("lang", "source1", "source2")
            .agg(F.sum(difference("p1", "p2") - difference("p1", "p02") - difference("p01", "p2") + difference("p01", "p02")).alias("met")))
    equal = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    against = (_side(equal, 1, ("lang",)).join(_side(sources.select("lang", "source", "p0"), 2, ("lang",)), "lang").filter("source1 <> source2")
               .groupBy("lang", "source1", "source2").agg(F.sum(F.col("terms1") * difference("p1", "p02")).alias("own")))
    turned = against.select("lang", F.col("source1").alias("source2"), F.col("source2").alias("source1"), F.col("own").alias("other"))
    on = ["lang", "source1", "source2"]
    pairs = (_side(sources, 1, ("lang", "v")).join(_side(sources.drop("v"), 2, ("lang",)), "lang").filter("source1 < source2")
             .join(both, on, "left").join(against, on, "left").join(turned, on, "left"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    value = zero("met") + zero("own") + zero("other") + zero((F.col("v") - F.col("held1") - F.col("held2")) * difference("p01", "p02"))
    one = pairs.select("lang", "source1", "source2", value.cast("long").alias("value"))
    every = one.select("lang", F.col("source1").alias("source"), F.col("source2").alias("item"), "value").unionByName(
        one.select("lang", F.col("source2").alias("source"), F.col("source1").alias("item"), "value"))
    return _ranked(every, "pair")


def _outstanding(shares: DataFrame, sources: DataFrame, top: int) -> DataFrame:
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    totals = sources.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    judged = (shares.join(whole, ["lang", "term"]).join(totals, "lang")
              .withColumn("q", share("n_lang", "total_lang", "v")).filter("p > q")
              .select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value")))
    return _ranked(judged, "term").filter(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
