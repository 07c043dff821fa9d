"""Removal of long repeated substrings, by a sorted sample of suffixes.

A byte goes if some ``length`` bytes that cover it also start anywhere else. Sorting
every suffix of the corpus would move each byte many times over, so suffixes start at
content-chosen anchors only. A window (``length`` bytes from one place) has as its anchor
the place whose next ``GRAM`` bytes hash lowest in it; equal windows therefore have
their anchors at the same offset. Neighbouring windows with one anchor are a *run*, and a run
is one suffix record of two tokens: the anchor's bytes lead, the run's whole string
follows. Where a text repeats itself with a short period, run after run has the same
tokens; those are one record, which is known to repeat.

Records are range-partitioned by sampled splitters, each bucket is sorted by a
multikey sort and compared with its neighbours' edges (``sorted_buckets``):

* an anchor seen once: none of the run's windows can repeat;
* the same whole string twice: all of them do;
* the same anchor in different strings: one record of each string is looked at more
  closely, first in parts of ``PART`` offsets, then window by window, by the same sort.

Texts are read for the runs that need it only. Matches never cross documents.

If asked, a byte also goes if some ``words`` words that cover it occur anywhere else.
Words are what ASCII white space parts, compared byte by byte; how they are parted does not
count. The same steps then run over the words' hashes in place of the bytes.

Cases: a null text is empty; a text shorter than ``length`` loses nothing. Rows that
repeat repeat each other's text, so all that is long enough goes. Ids may repeat or be
null: results follow the text. Other columns stay; result columns replace their namesakes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelfwise.llm.names import unused
from shelfwise.llm.pretokens import portions
from shelfwise.llm.sorted_buckets import compared
from shelfwise.llm.windows import Substrings, anchored_runs
from shelfwise.llm.words import VISIBLE, mixed, word_hashes, word_places
from shelfwise.llm.workers import ship_code, slices
from shelfwise.sources.scratch import staged

#: Offsets that are looked at together before single ones (an eighth of the length at most).
PART = 16
#: Bytes of texts whose arrays, some hundred times as large, a worker holds at once (of a longer text: all).
HELD = 1 << 18
_NAME = ["d", "n_bytes"]


def _salted(*numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        out = mixed(out + x.astype(np.uint64))
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def with_spans(docs: DataFrame, length: int = 400, text: str = "text", keep_text: bool = False, words: int | None = None,
               less: str | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans ([first, end) in bytes, merged) and, if asked, kept.

    kept is the text that stays; of a character that a cut goes through, nothing stays in it. If ``less`` names one more
    column, it is the text that stays when windows of ``words`` words go too, and all other results are of bytes alone.
    """
    spark = docs.sparkSession
    ship_code(spark)
    new = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                   "spans array<struct<first: long, end: long>>" + ", kept string" * keep_text + (f", `{less}` string" if less else ""))
    rest = docs.drop(*(set(new.names) - {text}))
    digest, size, cut_at, word_cut_at = unused(rest, "d", "n_bytes_", "cut", "word_cut")
    whole = F.coalesce(text, F.lit(""))
    joined = rest.withColumns({digest: F.xxhash64(whole), size: F.octet_length(whole).cast("long")})
    texts = joined.select(F.col(digest).alias("d"), F.col(size).alias("n_bytes"), whole.alias("text"))
    for name, made in [(cut_at, _cuts(texts, length))] + ([(word_cut_at, _cuts(texts, words, _WORDS))] if words else []):
        joined = joined.join(made.toDF(digest, size, name), [digest, size], "left")
    # The text is in the result only under a name of the caller's; a namesake of a result column is only read.
    schema = T.StructType([*(f for f in rest.schema.fields if f.name not in new.names), *new.fields])
    columns_kept, added = [c for c in rest.columns if c not in new.names], new.names

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            word_cuts = batch.column(word_cut_at).to_pylist() if words else [None] * batch.num_rows
            for data, cut, word_cut in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(cut_at).to_pylist(), word_cuts):
                data = data or b""
                both = _merged((cut or []) + _in_bytes(data, word_cut or []))
                spans = _merged(cut or []) if less else both
                kept = _without(data, spans)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             [{"first": a, "end": b} for a, b in spans], *[kept.decode(errors="ignore")] * keep_text,
                             *[_without(data, both).decode(errors="ignore")] * bool(less)))
            columns = list(zip(*rows)) or [[] for _ in added]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct({"first": pa.int64(), "end": pa.int64()})), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns_kept), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[*columns_kept, *added])

    return joined.mapInArrow(remove, schema)


def _merged(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted((c["first"], c["end"]) for c in cut):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(f for f, _ in spans), len(data)]))


def _in_bytes(data: bytes, cut: list[dict]) -> list[dict]:
    """Ranges of words as ranges of bytes, from the first word's first byte to the last word's end."""
    if not cut:
        return []
    starts, ends = word_places(np.frombuffer(data, np.uint8), VISIBLE)
    return [{"first": int(starts[c["first"]]), "end": int(ends[c["end"] - 1])} for c in cut]


@dataclass(frozen=True)
class _Unit:
    """What a window is made of: each takes ``width`` bytes of a text's units, and ``least`` bytes of the text at least."""

    of: Callable[[bytes], bytes]
    width: int
    least: Callable[[int], int]


_BYTES = _Unit(lambda text: text, 1, lambda length: length)
_WORDS = _Unit(lambda text: word_hashes(text, VISIBLE).tobytes(), 8, lambda length: 2 * length - 1)


def _cuts(texts: DataFrame, length: int, unit: _Unit = _BYTES) -> DataFrame:
    """d, n_bytes, cut: ranges of units to remove of each text that has any."""
    gram = length // 2
    texts = texts.filter(F.col("n_bytes") >= unit.least(length))
    runs = compared(staged(texts.mapInArrow(_run_records(length, gram, unit), _RUN), "runs"), "runs")
    strings = staged(_strings(texts, runs.filter("many and leads"), length, unit), "strings")
    parts = compared(staged(strings.mapInArrow(_part_records(length, unit), _PART), "parts"), "parts")
    asked = parts.filter("many and leads").groupBy(*_NAME, "first").agg(F.collect_list(F.struct("high", "low")).alias("offsets"))
    singles = compared(staged(strings.join(asked, [*_NAME, "first"]).mapInArrow(_window_records(length, unit), _WINDOW), "windows"), "windows")
    ranges = (runs.filter("same").select(*_NAME, F.struct("first", (F.col("first") + F.col("span") + F.col("more") + length).alias("end")).alias("range"))
              .unionByName(parts.filter("same").select(*_NAME, F.struct((F.col("anchor") - F.col("high")).alias("first"),
                                                                        (F.col("anchor") - F.col("low") + length).alias("end")).alias("range")))
              .unionByName(singles.filter("same").select(*_NAME, F.struct("first", (F.col("first") + length).alias("end")).alias("range"))))
    return ranges.groupBy(*_NAME).agg(F.collect_set("range").alias("cut"))  # as many as one text has


_RUN = "t1 long, t2 long, salt long, d long, n_bytes long, first long, span int, offset int, more long"
_PART = "t1 long, t2 long, salt long, d long, n_bytes long, first long, anchor long, high int, low int"
_WINDOW = "t1 long, t2 long, salt long, d long, n_bytes long, first long"


def _salts(n: int, before: int) -> np.ndarray:
    return (TaskContext.get().partitionId() << 40) + before + np.arange(n)


def _run_records(length: int, gram: int, unit: _Unit):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            d, size = (np.asarray(batch.column(c)) for c in _NAME)
            for a, b in portions(texts, HELD):
                held = Substrings([unit.of(t) for t in texts[a:b]], unit.width)
                owner, first, last, anchor = anchored_runs(held, length, gram)
                t1, t2 = held.hash(anchor, anchor + gram), _salted(held.hash(first, last + length), anchor - first)
                goes_on = np.zeros(len(owner), bool)
                goes_on[1:] = (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]) & (owner[1:] == owner[:-1])
                lead = np.flatnonzero(~goes_on)
                more = last[np.append(lead[1:], len(owner))[:len(lead)] - 1] - last[lead]
                t1, t2, owner, first, last, anchor = (x[lead] for x in (t1, t2, owner, first, last, anchor))
                yield pa.RecordBatch.from_arrays(
                    [_long(t1), _long(t2), _long(_salts(len(owner), done)), _long(d[a:b][owner]), _long(size[a:b][owner]),
                     _long(first - held.starts[owner]), pa.array((last - first).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), _long(more)],
                    names=["t1", "t2", "salt", *_NAME, "first", "span", "offset", "more"])
                done += len(owner)

    return make


def _strings(texts: DataFrame, runs: DataFrame, length: int, unit: _Unit) -> DataFrame:
    """d, n_bytes, first, span, offset and string (from the run's first unit to its last window's end).

    Equal texts are one before the shuffle; a text's runs are as many as it has.
    """
    wanted = runs.groupBy(*_NAME).agg(F.collect_set(F.struct("first", "span", "offset")).alias("runs"))
    one = texts.groupBy(*_NAME).agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(d, n, r["first"], r["span"], r["offset"], units[r["first"] * unit.width:(r["first"] + r["span"] + length) * unit.width])
                    for d, n, units, own in zip(*(batch.column(c).to_pylist() for c in _NAME),
                                                map(unit.of, batch.column("text").cast(pa.binary()).to_pylist()), batch.column("runs").to_pylist())
                    for r in own]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[*_NAME, "first", "span", "offset", "string"])

    return one.join(wanted, _NAME).mapInArrow(cut, "d long, n_bytes long, first long, span int, offset int, string binary")


def _part_records(length: int, unit: _Unit):
    size_of = max(1, min(PART, length // 8))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            strings = batch.column("string").to_pylist()
            d, size, first, span, offset = (np.asarray(batch.column(c)).astype(np.int64) for c in (*_NAME, "first", "span", "offset"))
            for a, b in portions(strings, HELD):
                held = Substrings(strings[a:b], unit.width)
                at, highest, lowest = held.starts + offset[a:b], offset[a:b], offset[a:b] - span[a:b]  # of the anchors, in the joined strings
                n = highest // size_of - lowest // size_of + 1
                own = np.repeat(np.arange(len(n)), n)
                part = lowest[own] // size_of + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                high, low = np.minimum(highest[own], part * size_of + size_of - 1), np.maximum(lowest[own], part * size_of)
                # Common to all windows of the part, whether or not this run has them all.
                core = held.hash(at[own] - part * size_of, at[own] - part * size_of - (size_of - 1) + length)
                t2 = _salted(held.hash(at[own] - high, at[own] - low + length), high, low)
                yield pa.RecordBatch.from_arrays(
                    [_long(_salted(core, part)), _long(t2), _long(_salts(len(own), done)), _long(d[a:b][own]), _long(size[a:b][own]), _long(first[a:b][own]),
                     _long((first + offset)[a:b][own]), pa.array(high.astype(np.int32)), pa.array(low.astype(np.int32))],
                    names=["t1", "t2", "salt", *_NAME, "first", "anchor", "high", "low"])
                done += len(own)

    return make


def _window_records(length: int, unit: _Unit):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            strings, offsets = batch.column("string").to_pylist(), batch.column("offsets").to_pylist()
            d, size, first, offset = (np.asarray(batch.column(c)).astype(np.int64) for c in (*_NAME, "first", "offset"))
            for a, b in portions(strings, HELD):
                held = Substrings(strings[a:b], unit.width)
                own = np.array([i for i, parts in enumerate(offsets[a:b]) for p in parts for _ in range(p["low"], p["high"] + 1)], np.int64)
                o = np.array([o for parts in offsets[a:b] for p in parts for o in range(p["low"], p["high"] + 1)], np.int64)
                start = offset[a:b][own] - o
                t1 = held.hash(held.starts[own] + start, held.starts[own] + start + length)
                yield pa.RecordBatch.from_arrays(
                    [_long(t1), _long(np.zeros(len(own), np.int64)), _long(_salts(len(own), done)), _long(d[a:b][own]), _long(size[a:b][own]),
                     _long(first[a:b][own] + start)], names=["t1", "t2", "salt", *_NAME, "first"])
                done += len(own)

    return make
