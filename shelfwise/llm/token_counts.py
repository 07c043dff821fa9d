"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie end to end in one array of symbols. In each
round every sequence finds the lowest rank among its adjacent pairs and applies
that pair at all its places at once; sequences without a known pair are done and
leave the arrays. Only counts of what survives are kept: no token is ever a string.

Cases: a null text has no bytes and no tokens; so has an empty one. The special
token's string inside a text counts one, as in the library. Every row is counted,
repeated ones as well; other columns stay, and result columns replace input columns
of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from shelfwise.llm.pretokens import SPECIAL, Memo, pieces, portions
from shelfwise.llm.workers import ship_code, slices

_NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as printable letters: those that print stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of pairs of symbols. Symbols 0-255 are the bytes, 256 + rank is what the pair of that rank becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        symbol = _byte_letters()
        pairs = np.empty((len(merges), 2), np.int64)
        for rank, (left, right) in enumerate(merges):
            pairs[rank] = symbol[left], symbol[right]
            symbol.setdefault(left + right, 256 + rank)
        self.into = np.array([symbol[left + right] for left, right in merges], np.int32)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        self.of_bytes = np.full(1 << 16, _NONE, np.int32)
        low = (pairs < 256).all(axis=1)
        self.of_bytes[pairs[low, 0] << 8 | pairs[low, 1]] = np.flatnonzero(low)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each sequence ends with."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = sizes.copy()
        symbols = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int32)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        first_round = True
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            if first_round:
                ranks = np.where(same, self.of_bytes[symbols[:-1] << 8 | symbols[1:]], _NONE)
                first_round = False
            else:
                ranks = np.where(same, self.rank(symbols[:-1], symbols[1:]), _NONE)
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            ranks = np.append(ranks, _NONE)
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            out[owner[starts]] = lengths
            going = np.repeat(lowest != _NONE, lengths)
            if not going.any():
                break
            chosen = (ranks == np.repeat(lowest, lengths)) & (ranks != _NONE)
            at = np.flatnonzero(chosen)
            # Equal neighbours overlap ("aaa"): of a run of chosen places every second one merges.
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = self.into[ranks[at]]
            going[at + 1] = False
            symbols, owner = symbols[going], owner[going]
        return out


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    """One per worker process; the vocabulary is read once."""
    merges = Merges(path)

    def compute(new: list[bytes]) -> list[int]:
        return [n for a, b in portions(new) for n in merges.counts(new[a:b]).tolist()]

    return Memo(compute)


def count_tokens(texts: list[bytes], path: str) -> list[int]:
    memo, out = _memo(path), []
    for a, b in portions(texts):
        cut = [(data.count(SPECIAL), [p for part in data.split(SPECIAL) for p in pieces(part)]) for data in texts[a:b]]
        known = memo.ready({p for _, own in cut for p in own})
        out += [special + sum(map(known.__getitem__, own)) for special, own in cut]
    return out


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens). ``path`` is the vocabulary's .json file on every executor."""
    new = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    ship_code(docs.sparkSession)
    kept = docs.drop(*new)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in new.items())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            n = count_tokens(texts, path)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[*batch.schema.names, *new])

    return kept.mapInArrow(count, schema)
