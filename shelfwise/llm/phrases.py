"""Collocations of two and three words from a weighted de Bruijn graph.

Texts (A-Z lower-cased) fall into pieces at ``.,;:!?`` and line ends, pieces into words at
spaces and tabs. Nodes are pairs of neighbouring words, edges are triples, which lead from
their first pair to their second; an edge weighs how often the triple occurs. A piece's last
pair and last word have no triple of their own and are recorded as edges to the piece's end.
So a pair's count is its node's outflow, ends included, and a word's count is the outflow of
all nodes that begin with it, ends included: the text is gone through once, for triples only.

Then the graph of edges that reach the threshold is compacted: a node through which exactly
one edge passes, all of the flow coming in and going out by it, is inner to a path, and
paths are told from their first edge by pointer doubling. Inside a path all counts equal
the path's weight; only at its two ends counts are looked up. Inner pairs lie in a triple
that is as frequent, so they are no collocations of their own.

Bounds: edges are dealt by their first word, so that all counts come from one shuffle.
Words and pairs that a bounded sample of rows (``SAMPLE_ROWS``) shows to be frequent are
dealt by pair or triple as well and summed once more; which ones are salted never changes a
result. A path's words are gathered in one row, which is no longer than the longest piece.

Cases: null text is empty, null lang is ``und``. Repeated rows count again. A lang without
candidates gives no rows; equal scores and counts are ordered by the phrase's bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.pretokens import portions
from shelfwise.llm.workers import ship_code, slices
from shelfwise.sources.scratch import staged

#: Rows sampled for words and pairs that are so frequent that one task should not get all of them,
#: the share from which they are, and into how many parts they go. At most 1 / share of each are found.
SAMPLE_ROWS, HOT_SHARE, PARTS = 2_000, 1 / 5_000, 64
#: Occurrences and distinct words a task holds before it counts them and puts the counts out.
HELD, HELD_WORDS = 4_000_000, 1 << 20
#: Triples put out at once.
PUT_OUT = 1 << 18
#: Tokens numbered at once; with HELD_WORDS, numbers stay below 2^21, so that three fit in one long.
AT_ONCE = 1 << 20
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in order, with a mark at the end of each piece."""
    marked = (text.translate(_TABLE) + b"\n").replace(b"\n", b" " + _BREAK + b" ")
    return list(filter(None, marked.split(b" ")))


class _Words(dict):
    """Numbers of a lang's words; 0 is the end of a piece. All langs count with one list."""

    def __init__(self, names: list):
        super().__init__({_BREAK: 0})
        self.names = names

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


def _grams(batches: Iterator[pa.RecordBatch], hot_words: frozenset, hot_pairs: frozenset) -> Iterator[pa.RecordBatch]:
    """(lang, first, part, edges): each distinct triple of what a task holds at once, as "second third n" in a line of its first word."""
    names, langs, words, found, held = [b""], [b""], {}, [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
        text = pa.array(names, pa.binary()).cast(pa.string())
        lang = pa.array(langs, pa.binary()).cast(pa.string())
        hot = np.fromiter(((x, w) in hot_words for x, w in zip(langs, names)), bool, len(names))
        for at in range(0, len(keys), PUT_OUT):
            ids = [(keys[at:at + PUT_OUT] >> np.uint64(s) & np.uint64((1 << 21) - 1)).astype(np.int64) for s in (42, 21, 0)]
            part, counts = _parts(ids, hot, names, langs, hot_pairs), n[at:at + PUT_OUT]
            if part.any():
                order = np.lexsort((part, ids[0]))
                ids, part, counts = [i[order] for i in ids], part[order], counts[order]
            line = pc.binary_join_element_wise(text.take(pa.array(ids[1])), text.take(pa.array(ids[2])), pa.array(counts).cast(pa.string()), " ")
            starts = np.flatnonzero(np.concatenate(([True], (ids[0][1:] != ids[0][:-1]) | (part[1:] != part[:-1]))))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(part)), pa.int32()), line), "\n")
            own = pa.array(ids[0][starts])
            yield pa.RecordBatch.from_arrays([lang.take(own), text.take(own), pa.array(part[starts]), lines], names=["lang", "first", "part", "edges"])

    for batch in slices(batches):
        own, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text"))
        for a, b in portions(texts):
            for lang, text in zip(own[a:b], texts[a:b]):
                tokens = tokens_of(text)
                for at in range(0, len(tokens), AT_ONCE):
                    if held > HELD or len(names) > HELD_WORDS:
                        yield from counted()
                        names, langs, words, found, held = [b""], [b""], {}, [], 0
                    if lang not in words:
                        words[lang] = _Words(names)
                    some = tokens[at:at + AT_ONCE + 2]
                    ids = np.zeros(len(some) + 2, np.uint64)
                    ids[:len(some)] = np.fromiter(map(words[lang].__getitem__, some), np.uint64, len(some))
                    langs.extend([lang] * (len(names) - len(langs)))
                    first, second = ids[:-2], ids[1:-1]
                    third = np.where(second > 0, ids[2:], np.uint64(0))
                    keys = (first << np.uint64(42) | second << np.uint64(21) | third)[:AT_ONCE]
                    found.append(keys[first[:AT_ONCE] > 0])
                    held += len(found[-1])
    yield from counted()


def _parts(ids: list[np.ndarray], hot: np.ndarray, names: list[bytes], langs: list[bytes], hot_pairs: frozenset) -> np.ndarray:
    """0, or for a frequent word a part by its second word, up to PARTS, or for a frequent pair one by the third, above PARTS."""
    part, pairs = np.zeros(len(ids[0]), np.int32), {}
    for i in np.flatnonzero(hot[ids[0]]).tolist():
        first, second = ids[0][i], ids[1][i]
        if (first, second) not in pairs:
            pairs[first, second] = (langs[first], names[first], names[second]) in hot_pairs, 1 + _spread(names[second])
        is_hot, own = pairs[first, second]
        part[i] = PARTS + 1 + (own + _spread(names[ids[2][i]])) % PARTS if is_hot else own
    return part


def _spread(word: bytes) -> int:
    """A part for a word, alike in all tasks."""
    return int.from_bytes(word[-4:], "little") * 0x9E3779B1 % (1 << 32) * PARTS >> 32


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (lang, first, part), cut between keys."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        same = functools.reduce(pc.and_, [pc.equal(rows.column(c), rows.column(c)[-1]) for c in ("lang", "first", "part")])
        start = rows.num_rows - pc.sum(same).as_py()
        if start:
            yield rows.slice(0, start)
        held = rows.slice(start)
    if held is not None:
        yield held


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, first, second, third, f, whole): what reaches the threshold, parts of split words and pairs, and the words of each lang."""
    totals: dict[str, int] = {}

    def out(keys: pa.Table, at, second, third, f, whole) -> list[pa.RecordBatch]:
        rows, none = keys.take(at), pa.nulls(len(at), pa.string())
        columns = [rows["lang"], rows["first"], none if second is None else second, none if third is None else third, f, whole]
        return pa.table(columns, names=["lang", "first", "second", "third", "f", "whole"]).combine_chunks().to_batches()

    for rows in _whole_keys(batches):
        changed = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            changed[1:] = ~functools.reduce(pc.and_, [pc.equal(rows.column(c)[1:], rows.column(c)[:-1]) for c in ("lang", "first", "part")]).to_numpy()
        keys = rows.select(["lang", "first", "part"]).filter(pa.array(changed))
        lines = pc.split_pattern(rows.column("edges").combine_chunks(), "\n")
        key = np.repeat(np.cumsum(changed) - 1, pc.list_value_length(lines).to_numpy())
        words = pc.split_pattern(lines.flatten(), " ").flatten()
        column = lambda i: words.take(pa.array(np.arange(i, len(words), 3)))
        edges = pa.table({"key": key, "second": column(0), "third": column(1), "f": column(2).cast(pa.int64())})
        edges = edges.group_by(["key", "second", "third"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        nodes = edges.group_by(["key", "second"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        flows = nodes.group_by(["key"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        part = keys.column("part").to_numpy()
        edges = edges.filter(pc.and_(pc.greater_equal(edges["f"], least), pc.not_equal(edges["third"], "")))
        yield from out(keys, edges["key"], edges["second"], edges["third"], edges["f"], pa.array(np.ones(edges.num_rows, bool)))
        stays = pa.array((part[nodes["key"].to_numpy()] > PARTS) | (nodes["f"].to_numpy() >= least))
        nodes = nodes.filter(pc.and_(stays, pc.not_equal(nodes["second"], "")))
        yield from out(keys, nodes["key"], nodes["second"], None, nodes["f"], pa.array(part[nodes["key"].to_numpy()] <= PARTS))
        of_lang = pa.table({"lang": keys["lang"].take(flows["key"]), "f": flows["f"]}).group_by("lang", use_threads=False).aggregate([("f", "sum")])
        for lang, n in zip(of_lang["lang"].to_pylist(), of_lang["f_sum"].to_pylist()):
            totals[lang] = totals.get(lang, 0) + n
        own = part[flows["key"].to_numpy()]
        flows = flows.filter(pa.array((own > 0) | (flows["f"].to_numpy() >= least)))
        yield from out(keys, flows["key"], None, None, flows["f"], pa.array(part[flows["key"].to_numpy()] == 0))
    none = pa.nulls(len(totals), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), none, none, none, pa.array(totals.values(), pa.int64()), pa.array([False] * len(totals), pa.bool_())],
                                     names=["lang", "first", "second", "third", "f", "whole"])


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _counted(docs: DataFrame, hot: tuple[frozenset, frozenset], least: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(hot)
    key = ("lang", "first", "part")
    dealt = docs.mapInArrow(lambda batches: _grams(batches, *held.value), "lang string, first string, part int, edges string")
    found = staged(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        lambda batches: _summed(batches, least), "lang string, first string, second string, third string, f long, whole boolean"), "grams")
    again = found.filter("not whole").groupBy("lang", "first", "second", "third").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return found.filter("whole").drop("whole").unionByName(again)


def _hot(docs: DataFrame) -> tuple[frozenset, frozenset]:
    """Words, and pairs that begin with them, with a large share of a bounded sample; at most 2 / HOT_SHARE."""
    sample = docs.sample(min(1.0, SAMPLE_ROWS / max(docs.count(), 1)), seed=11)
    found = staged(_counted(sample, (frozenset(), frozenset()), 1).filter("third is null"), "sample")
    share = (found.filter("first is null").agg(F.sum("f")).first()[0] or 0) * HOT_SHARE
    hot = found.filter((F.col("f") > share) & F.col("first").isNotNull()).collect()
    coded = [tuple(x.encode() for x in (r["lang"], r["first"], r["second"]) if x is not None) for r in hot]
    return frozenset(x for x in coded if len(x) == 2), frozenset(x for x in coded if len(x) == 3)


def graph(docs: DataFrame, least: int) -> DataFrame:
    """(lang, first, second, third, f) of all words, pairs and triples that occur ``least`` times, and of each lang's words together.

    Words have no second and third, pairs no third; the count of all words has no first.
    """
    ship_code(docs.sparkSession)
    docs = _read(docs)
    return _counted(docs, _hot(docs), least)


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, words, f): edges joined where a node's whole flow goes in by one edge and out by one edge.

    edges: (lang, first, second, third, f); nodes: (lang, first, second, f).
    """
    source, target = F.struct("lang", "first", "second"), F.struct("lang", F.col("second").alias("first"), F.col("third").alias("second"))
    flow = nodes.select(source.alias("node"), F.col("f").alias("flow"))
    named = edges.select(F.struct("lang", "first", "second", "third").alias("edge"), source.alias("source"), target.alias("target"), "f")
    whole_out = named.join(flow, (F.col("source") == F.col("node")) & (F.col("f") == F.col("flow"))).select(F.col("edge").alias("behind"), "node")
    whole_in = named.join(flow, (F.col("target") == F.col("node")) & (F.col("f") == F.col("flow"))).select(F.col("edge").alias("ahead"), "node")
    steps = whole_out.join(whole_in, "node").select(F.col("behind").alias("edge"), F.col("ahead").alias("head"), F.lit(1).alias("steps"))
    steps = staged(steps, "paths")
    # Pointers double until each one's head has no edge before it. A ring cannot be inner all round: pieces begin somewhere.
    while True:
        onward = steps.select(F.col("edge").alias("head"), F.col("head").alias("_on"), F.col("steps").alias("_more"))
        moved = steps.join(onward, "head", "left")
        if moved.filter("_on is not null").limit(1).count() == 0:
            break
        steps = staged(moved.select("edge", F.coalesce("_on", "head").alias("head"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), "paths")
    placed = named.select("edge", "f").join(steps, "edge", "left").select(
        F.coalesce("head", "edge").alias("head"), F.struct(F.coalesce("steps", F.lit(0)).alias("at"), F.col("edge.third").alias("word")).alias("one"), "f")
    return placed.groupBy("head").agg(F.array_sort(F.collect_list("one")).alias("ones"), F.min("f").alias("f")).select(
        "head.lang", F.concat(F.array("head.first", "head.second"), F.col("ones.word")).alias("words"), "f")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left right)); counts of up to 16 digits, in decimals of 38."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", (wide(a) * wide(a)) * F.lit(1_000_000).cast("decimal(7,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, within_percent: int = 50) -> DataFrame:
    """Per lang the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found = staged(graph(docs, least), "graph")
    edges = found.filter("third is not null")
    nodes = found.filter("second is not null and third is null").drop("third")
    words = found.filter("first is not null and second is null").select("lang", F.col("first").alias("word"), "f")
    totals = found.filter("first is null").select("lang", F.col("f").alias("n"))
    compact = staged(paths(edges, nodes.filter(F.col("f") >= least)), "compact")

    # Triples are the windows of three words of a path; between two edges of a path a pair's count is the path's weight.
    window = compact.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("at"))
    triples = window.select("lang", F.get("words", F.col("at") - 1).alias("first"), F.get("words", F.col("at")).alias("second"), F.get("words", F.col("at") + 1).alias("third"),
                            F.col("f").alias("a"), F.when(F.col("at") > 1, F.col("f")).alias("begin"), F.when(F.col("at") < F.size("words") - 2, F.col("f")).alias("end"))
    at_begin = nodes.select("lang", "first", "second", F.col("f").alias("_begin"))
    at_end = nodes.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("f").alias("_end"))
    triples = (triples.filter("begin is not null").withColumn("_begin", F.lit(None).cast("long"))
               .unionByName(triples.filter("begin is null").join(at_begin, ["lang", "first", "second"])))
    triples = (triples.filter("end is not null").withColumn("_end", F.lit(None).cast("long"))
               .unionByName(triples.filter("end is null").join(at_end, ["lang", "second", "third"]).select(*triples.columns, "_end")))
    triples = staged(triples.select("lang", "first", "second", "third", "a", F.coalesce("begin", "_begin").alias("begin"), F.coalesce("end", "_end").alias("end")), "triples")

    longer = (triples.select("lang", "first", "second", "a")
              .unionByName(triples.select("lang", F.col("second").alias("first"), F.col("third").alias("second"), "a"))
              .groupBy("lang", "first", "second").agg(F.max("a").alias("longer")))
    pairs = (nodes.join(longer, ["lang", "first", "second"], "left")
             .filter(F.col("longer").isNull() | (100 * F.col("longer") < within_percent * F.col("f")))
             .select("lang", F.col("first"), F.col("second").alias("last"), F.concat_ws(" ", "first", "second").alias("phrase"), F.col("f").alias("a"),
                     F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end")))
    every = pairs.unionByName(triples.select("lang", "first", F.col("third").alias("last"), F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", "begin", "end"))
    every = (every.join(words.select("lang", F.col("word").alias("first"), F.col("f").alias("f1")), ["lang", "first"])
             .join(words.select("lang", F.col("word").alias("last"), F.col("f").alias("f2")), ["lang", "last"]))
    # Cut behind the first word: l is its count, r the rest's. Cut before the last word, where that is another cut.
    every = (every.withColumn("r1", F.coalesce("end", "f2")).withColumn("l2", F.coalesce("begin", "f1"))
             .withColumn("s1", score("a", "f1", "r1")).withColumn("s2", score("a", "l2", "f2")))
    first_cut = F.col("s1") <= F.col("s2")
    chosen = every.select("lang", "phrase", "a", F.when(first_cut, F.col("f1")).otherwise(F.col("l2")).alias("l"),
                          F.when(first_cut, F.col("r1")).otherwise(F.col("f2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
