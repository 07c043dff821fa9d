"""Windows of many texts at once: content-chosen anchors, and hashes of any substring."""

from __future__ import annotations

import numpy as np

from shelfwise.llm.words import _SPREAD, _powers_to, mixed


class Substrings:
    """Texts end to end; ``hash(start, end)`` of substrings in constant time each.

    Places count units of ``width`` bytes: 1 for bytes, 8 for words by their hashes.
    """

    def __init__(self, texts: list[bytes], width: int = 1):
        self.data = np.frombuffer(b"".join(texts), np.uint8 if width == 1 else np.uint64)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // width
        self.starts = np.concatenate(([0], self.ends[:-1]))
        power, self._inverse = _powers_to(len(self.data) + 1)
        self._sums = np.concatenate(([np.uint64(0)], np.cumsum((_SPREAD[self.data] if width == 1 else self.data) * power[:len(self.data)])))

    def hash(self, start, end) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` bytes from every place that has so many behind it."""
        n = max(len(self.data) - k + 1, 0)
        return mixed((self._sums[k:k + n] - self._sums[:n]) * self._inverse[:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from block-wise minima forwards and backwards."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchored_runs(texts: Substrings, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, anchor): runs of windows that have the same anchor.

    A window's anchor is the place in it whose ``k`` bytes hash lowest, of equal ones
    the last; it depends on the window's own bytes only, so equal windows have their
    anchors at the same offset.
    """
    empty = (np.empty(0, np.int64),) * 4
    if len(texts.data) < window:
        return empty
    bits = np.uint64(int(len(texts.data)).bit_length())
    grams = texts.grams(k)
    place = np.arange(len(grams), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_least((grams & ~low) | (low - place), window - k + 1)
    anchor = (low - (least & low)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts.ends)), texts.ends - texts.starts)[:len(anchor)]
    whole = np.arange(len(anchor)) + window <= texts.ends[owner]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh & whole)
    stops = np.flatnonzero(np.concatenate((fresh | ~whole, [True])))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    return owner[first], first, last, anchor[first]
