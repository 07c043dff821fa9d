"""An FM-index over a sequence of symbols, searched for many phrases at once.

The sequence's suffixes are sorted by prefix doubling; the symbols before them (the
Burrows-Wheeler transform) go into a wavelet matrix, whose ranks drive backward
search. Every ``SAMPLE``-th position of the sequence, and every one after a boundary,
is kept with its suffix; other suffixes walk back to one of those.

Symbol 0 is a boundary: no phrase holds it, and each boundary sorts as a symbol of
its own, so that no comparison runs across one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    walls = np.flatnonzero(symbols == 0)
    rank[symbols != 0] += len(walls)
    rank[walls] = np.arange(len(walls)) + 1
    step, order = 1, None
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:]
        key = rank << 32 | after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) + 1
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n:
            return order
        step *= 2


class WaveletMatrix:
    """Symbols by bits, highest first; ``ones[level][i]`` counts the ones before place i."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = symbols[np.argsort(bit, kind="stable")]

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often ``symbol`` stands before each place."""
        at, start = list(places), np.zeros_like(places[0])
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            high = (symbol >> (self.bits - 1 - level)) & 1 == 1
            step = lambda i: np.where(high, zeros + ones[i], i - ones[i])  # noqa: E731,B023
            at, start = [step(i) for i in at], step(start)
        return [i - start for i in at]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            high = ones[place + 1] - ones[place] == 1
            step = lambda i: np.where(high, zeros + ones[i], i - ones[i])  # noqa: E731,B023
            symbol, place, start = symbol << 1 | high, step(place), step(start)
        return symbol, place - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """``symbols`` (0 up to ``n_symbols`` - 1) must end with a boundary."""
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols))))
        self.tree = WaveletMatrix(before, n_symbols)
        self.kept = (order % SAMPLE == 0) | (before == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(self.kept)))
        self.positions = order[self.kept]
        self.size = len(symbols)

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of phrase, position) of every occurrence. ``phrases`` has a row each, filled from the left."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        done: list[tuple] = []
        for step in range(phrases.shape[1]):
            ended = lengths[live] == step
            done.append((live[ended], low[ended], high[ended]))
            live, low, high = live[~ended], low[~ended], high[~ended]
            symbol = phrases[live, lengths[live] - 1 - step]
            low, high = (self.below[symbol] + r for r in self.tree.rank(symbol, low, high))
            found = low < high
            live, low, high = live[found], low[found], high[found]
        done.append((live, low, high))
        live, low, high = (np.concatenate(x) for x in zip(*done))
        n = high - low
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(live, n), self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        out, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            kept = self.kept[rows]
            out[open_[kept]] = self.positions[self.kept_before[rows[kept]]] + steps
            open_, rows = open_[~kept], rows[~kept]
            symbol, rank = self.tree.at(rows)
            rows, steps = self.below[symbol] + rank, steps + 1
        return out
