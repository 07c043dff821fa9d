"""Pre-tokens of byte-level BPE: the pieces within which merges happen.

Pieces are bytes. Texts whose characters beyond ASCII are all letters go through a
pattern over bytes, in which every such byte counts as a letter; other texts go
through the pattern over characters. Both cut alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

#: The pre-token pattern of the published vocabulary, over characters and over bytes.
_CHARS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                       r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BYTES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
#: Fixed value: the vocabulary's one special token, which the library recognises inside texts.
SPECIAL = b"<|endoftext|>"

_LETTER = regex.compile(r"\p{L}")
_letters = {chr(c) for c in range(128)}


def _only_letters(text: str) -> bool:
    """Whether all characters beyond ASCII are letters (those met are remembered: at most the letters there are)."""
    new = set(text) - _letters
    found = {c for c in new if _LETTER.match(c)}
    _letters.update(found)
    return len(found) == len(new)


def pieces(data: bytes) -> list[bytes]:
    if data.isascii() or _only_letters(text := data.decode()):
        return _BYTES.findall(data)
    return [p.encode() for p in _CHARS.findall(text)]


class Memo:
    """Values of pieces, computed in batches and remembered up to ``size`` pieces.

    A new generation starts when the table is full; what the current batch needs is
    computed anew, so the bound never changes a result.
    """

    def __init__(self, compute: Callable[[list[bytes]], list], size: int = 300_000):
        self.compute, self.size, self.known = compute, size, {}

    def ready(self, wanted: set[bytes]) -> dict:
        if len(self.known) > self.size:
            self.known = {}
        new = list(wanted.difference(self.known))
        if new:
            self.known.update(zip(new, self.compute(new)))
        return self.known


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about ``most`` bytes together, so that memory follows the longest text."""
    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)
