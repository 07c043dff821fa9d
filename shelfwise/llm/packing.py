"""Packing documents into fixed-length sequences with bounded space, online.

Each partition keeps a fixed number of open windows. A document is cut into full
windows and a rest; full windows leave at once, and the rest goes where it fits
best, that is, leaves the least room. When it fits nowhere and all windows are open,
the fullest leaves and the rest opens a new one. What is still open at the end of a
partition is merged: the open windows of ``FAN_IN`` partitions are packed together by
the same rule, level by level, until one group is left. A group holds at most
``FAN_IN`` x ``OPEN`` windows, so no task's memory depends on the input.

Cases: a null text and an empty one are the end token alone. Documents that repeat,
or have no id, are packed as often as they occur. A document longer than a window
lies in several pieces; no id is dropped, none is doubled. An empty table packs into
nothing. Sequences are thought padded to their full length; padding is no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelfwise.llm.pretokens import SPECIAL, Memo, pieces, portions
from shelfwise.llm.token_counts import _byte_letters
from shelfwise.llm.workers import CACHES, ship_code, slices
from shelfwise.sources.scratch import staged

#: Windows a partition keeps open, and partitions whose open windows are merged in one group.
OPEN, FAN_IN = 64, 32
#: Pre-tokens whose ids a worker remembers, about 200 bytes each.
REMEMBERED = 400_000
#: Bits of a sequence's number within its partition.
_SERIAL_BITS = 36

_PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "part int, open boolean, ids binary")


class Windows:
    """Open windows of one packer. ``put`` gives back what leaves."""

    def __init__(self, length: int, most: int, first_id: int):
        self.length, self.most, self.next_id = length, most, first_id
        self.held: dict[int, list] = {}  # sequence id -> [used, items]

    def _new(self, used: int, items: list) -> int:
        self.held[self.next_id] = [used, items]
        self.next_id += 1
        return self.next_id - 1

    def put(self, size: int, item) -> list[tuple[int, list, bool]]:
        left = []
        if size == self.length:
            self.next_id += 1
            return [(self.next_id - 1, [(0, item)], False)]
        fits = [(used, -k) for k, (used, _) in self.held.items() if used + size <= self.length]
        if fits:
            at = -max(fits)[1]
        else:
            if len(self.held) == self.most:
                fullest = max((used, -k) for k, (used, _) in self.held.items())
                left.append(self._leave(-fullest[1], False))
            at = self._new(0, [])
        window = self.held[at]
        window[1].append((window[0], item))
        window[0] += size
        if window[0] == self.length:
            left.append(self._leave(at, False))
        return left

    def _leave(self, key: int, still_open: bool) -> tuple[int, list, bool]:
        return key, self.held.pop(key)[1], still_open

    def rest(self, still_open: bool) -> list[tuple[int, list, bool]]:
        return [self._leave(k, still_open) for k in sorted(self.held)]


@lru_cache(maxsize=2)
def _memo(path: str) -> tuple[Memo, bytes]:
    """Ids of pre-tokens as little-endian bytes, and those of the special token, by the library.

    Its model merges a pre-token at once; a whole tokenizer would cut each again and build an encoding around its ids.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, {b: letter for letter, b in _byte_letters().items()}

    def compute(new: list[bytes]) -> list[bytes]:
        out = []
        for a, b in portions(new):
            ids = [[t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in new[a:b]]
            flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
            out += [flat[x:y] for x, y in zip([0, *ends], ends)]
        return out

    special = tokenizer.token_to_id(SPECIAL.decode())
    return Memo(compute, REMEMBERED), special.to_bytes(4, "little")


CACHES["packing"] = _memo.cache_clear


def encoded(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text, four little-endian bytes each."""
    memo, special = _memo(path)
    for a, b in portions(texts):
        cut = [[pieces(part) for part in data.split(SPECIAL)] for data in texts[a:b]]
        known = memo.ready(set(chain.from_iterable(chain.from_iterable(cut))))
        for parts in cut:
            yield special.join(b"".join(map(known.__getitem__, own)) for own in parts)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1,
         keep_ids: bool = True, n_open: int = OPEN) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    ids_crc32 is over the piece's ids as little-endian 32-bit numbers, which is also
    the form of ids. ``path`` is the vocabulary's .json file on every executor.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = T._parse_datatype_string(f"`{key}` {kind}, {_PIECE}")
    end = end_id.to_bytes(4, "little")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, rows = Windows(length, n_open, part << _SERIAL_BITS), []
        for batch in slices(batches, keeps="packing"):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), encoded(texts, path)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start:4 * (start + length)]
                    size = len(piece) // 4
                    item = (name, start, size, zlib.crc32(piece), total, piece if keep_ids else None)
                    rows += _rows(windows.put(size, item), part)
                if len(rows) >= 500:
                    yield _batch(rows, schema)
                    rows = []
        yield _batch(rows + _rows(windows.rest(True), part), schema)

    done = staged(docs.select(key, text).mapInArrow(first_pass, schema), "packed")
    packed, left = [done.filter("not open")], done.filter("open")
    n_parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while True:
        n_groups = -(-n_parts // FAN_IN)
        merged = _merged(left, length, n_open, schema, level, last=n_groups == 1)
        if n_groups > 1:
            merged = staged(merged, "packed")
        packed.append(merged.filter("not open"))
        if n_groups == 1:
            break
        left, n_parts, level = merged.filter("open"), n_groups, level + 1
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open", *([] if keep_ids else ["ids"]))


def _rows(windows: list[tuple[int, list, bool]], part: int) -> list[tuple]:
    return [(*item[:5], number, offset, part, still_open, item[5])
            for number, items, still_open in windows for offset, item in items]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _merged(left: DataFrame, length: int, n_open: int, schema: T.StructType, level: int, last: bool) -> DataFrame:
    """The open windows of neighbouring partitions packed together; each moves as a whole."""
    key = schema.names[0]

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        part = group[0].as_py()
        windows, out = Windows(length, n_open, (level << 58) | part << _SERIAL_BITS), []
        by_window: dict[int, list] = {}
        for row in zip(*(rows.column(n).to_pylist() for n in schema.names)):
            by_window.setdefault(row[5], []).append(row)
        blocks = [sorted(own, key=lambda r: r[6]) for _, own in sorted(by_window.items())]
        for own in sorted(blocks, key=lambda own: -sum(r[2] for r in own)):
            out += windows.put(sum(r[2] for r in own), own)
        out += windows.rest(not last)
        flat = [(*r[:5], number, at + r[6], part, still_open, r[9])
                for number, items, still_open in out for at, own in items for r in own]
        return pa.Table.from_batches([_batch(flat, schema)])

    return (left.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part")
            .applyInArrow(merge, schema).select(key, *schema.names[1:]))
