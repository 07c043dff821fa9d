"""Words of many texts at once, as 64-bit hashes computed over one array of bytes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of more bytes are digested whole: a polynomial modulo 2^64 has known collisions from some hundred bytes on.
LONG = 32

#: Bytes of a word: letters and digits of ASCII (lower case) and everything beyond ASCII ...
ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
#: ... or everything but ASCII white space.
VISIBLE = ~np.isin(np.arange(256), [32, *range(9, 14)])

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; kept for the usual sizes."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE))
    if n <= 1 << 22:
        _powers = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, so that order and low bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hashes: np.ndarray   # of all words of all texts, in order
    first: np.ndarray    # of each text: its first word, and one more entry for the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def hashed_words(texts: list[bytes], inside: np.ndarray) -> Words:
    """Words (runs of bytes ``inside``, A-Z lower-cased) of each text. A word's hash depends on its bytes alone."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    ends_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts, ends = word_places(data, inside)
    return Words(_hashes(data, starts, ends), np.concatenate(([0], np.searchsorted(starts, ends_at))))


def word_hashes(text: bytes, inside: np.ndarray) -> np.ndarray:
    """The hash of each word of one text, as it is written."""
    data = np.frombuffer(text, np.uint8)
    return _hashes(data, *word_places(data, inside))


def word_places(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes ``inside``."""
    edge = np.diff(np.concatenate(([False], inside[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_SPREAD[data] * power[:len(data)])))
    out = mixed((sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out
