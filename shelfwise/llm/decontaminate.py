"""Benchmark decontamination: an FM-index per shard of training text, asked for test phrases.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z
lower-cased. A phrase is every ``n`` consecutive words of a benchmark item, or the
whole item if it has fewer. Each shard (about ``SHARD`` bytes of whole documents) is
indexed as words: words that no phrase holds are boundaries, and stretches between
boundaries that are shorter than every phrase are left out, since nothing can occur
there. Backward search finds all phrases together; their places are merged to spans.

The phrases go to every executor in slices of ``SLICE`` bytes, each asked in turn, so
the benchmark may be of any size; documents are read once and never shuffled.

Cases: null and empty texts have no words; an item without words holds no phrase; rows
that repeat an item id are one item. Items without id hold no phrase unless
``unnamed_items``; then they hit words like others, and have no place in n_items and
items_sha256. Documents may repeat. A document in which
nothing occurs has no spans and the digest of the empty string. Other columns stay;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfwise.llm.fm_index import FMIndex
from shelfwise.llm.pretokens import portions
from shelfwise.llm.words import ALNUM, hashed_words
from shelfwise.llm.workers import ship_code, slices

SHARD, SLICE = 2 << 20, 16 << 20


@dataclass
class Phrases:
    """Distinct phrases of some items, over the vocabulary of their own words (numbered from 1)."""

    vocabulary: np.ndarray      # sorted word hashes
    table: np.ndarray           # a phrase per row, filled from the left
    lengths: np.ndarray
    items: list[tuple]          # the items of each phrase


def phrases_of(items: list[tuple], n: int) -> Phrases | None:
    words = hashed_words([text for _, text in items], ALNUM)
    vocabulary = np.unique(words.hashes)
    numbers = np.searchsorted(vocabulary, words.hashes) + 1
    owners: dict[tuple, set] = {}
    for (item, _), a, b in zip(items, words.first, words.first[1:]):
        own = numbers[a:b].tolist()
        for i in range(max(len(own) - n + 1, min(len(own), 1))):
            owners.setdefault(tuple(own[i:i + n]), set()).update(() if item is None else (item,))
    if not owners:
        return None
    table = np.zeros((len(owners), n), np.int64)
    for row, phrase in zip(table, owners):
        row[:len(phrase)] = phrase
    return Phrases(vocabulary, table, np.array([len(p) for p in owners]), [tuple(v) for v in owners.values()])


def find_in_shard(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of each occurrence in a shard whose texts start at the words ``first``."""
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    # Stretches of known words that do not cross from one text into the next.
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    heads = first[:-1][first[:-1] < len(hashes)]
    opens[heads] |= known[heads]
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(np.append(~known, True))
    cut = np.minimum(stops[np.searchsorted(stops, starts)], np.append(starts[1:], len(hashes)))
    long = cut - starts >= phrases.lengths.min()
    starts, sizes = starts[long], (cut - starts)[long]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Each stretch and the boundary behind it.
    begin = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(sizes.sum() + len(sizes)) - np.repeat(begin, sizes + 1) + np.repeat(starts, sizes + 1)
    symbols = np.append(at, 0)[np.minimum(place, len(at))] + 1
    symbols[begin + sizes] = 0
    phrase, found = FMIndex(symbols, len(phrases.vocabulary) + 1).find(phrases.table, phrases.lengths)
    return phrase, place[found]


def hit_words(texts: list[bytes], slices: list) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text of a shard: number of words, merged spans [first, end) of hit words, ids of items that occur (sorted as strings)."""
    words = hashed_words(texts, ALNUM)
    depth = np.zeros(len(words.hashes) + 1, np.int32)
    items: dict[int, set] = {}
    for held in slices:
        phrases = held.value
        if phrases is None:
            continue
        number, place = find_in_shard(words.hashes, words.first, phrases)
        np.add.at(depth, place, 1)
        np.add.at(depth, place + phrases.lengths[number], -1)
        owner = np.searchsorted(words.first, place, side="right") - 1
        for doc, phrase in np.unique(np.column_stack([owner, number]), axis=0).tolist():
            items.setdefault(doc, set()).update(phrases.items[phrase])
    covered = np.cumsum(depth[:-1]) > 0
    for i, (a, b) in enumerate(zip(words.first, words.first[1:])):
        edge = np.diff(np.concatenate(([0], covered[a:b].astype(np.int8), [0]))) if i in items else np.empty(0)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        yield int(b - a), spans, sorted(map(str, items.get(i, ())))


def with_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text",
                       item: str = "item_id", item_text: str = "text", unnamed_items: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans (hit words, [first, end)).

    A document is contaminated if a word is hit and at least one word of ``share`` is.
    """
    ship_code(docs.sparkSession)
    new = T._parse_datatype_string("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                                   "spans array<struct<first: int, end: int>>")
    kept = docs.drop(*new.names)
    schema = T.StructType([*kept.schema.fields, *new.fields])
    sent = _sent(benchmark.select(item, item_text).dropna(subset=[item_text] if unnamed_items else [item, item_text]), n)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            rows = []
            for a, b in portions(texts, SHARD):
                for n_words, spans, found in hit_words(texts[a:b], sent):
                    n_hit = sum(end - begin for begin, end in spans)
                    rows.append((n_words, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
                                 n_hit > 0 and share * n_hit >= n_words, [{"first": x, "end": y} for x, y in spans]))
            columns = list(zip(*rows)) or [[] for _ in new]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct({"first": pa.int32(), "end": pa.int32()}))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[*batch.schema.names, *new.names])

    return kept.mapInArrow(judge, schema)


def _sent(benchmark: DataFrame, n: int) -> list:
    """The phrases, broadcast in slices; the driver holds one slice at a time."""
    context, slices, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for item, text in benchmark.distinct().toLocalIterator():
        held.append((item, text.encode()))
        size += len(held[-1][1])
        if size >= SLICE:
            slices.append(context.broadcast(phrases_of(held, n)))
            held, size = [], 0
    return [*slices, context.broadcast(phrases_of(held, n))] if held else slices
