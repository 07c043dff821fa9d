"""Tokens and boolean text expressions.

Tokens are runs of Unicode letters and digits, case-folded, with the accents of
Latin letters removed, so ``korsbar`` finds ``körsbär``. An expression is a
small tree of Python objects that becomes one Spark ``Column`` over token
arrays; nothing is parsed and no row leaves the JVM.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
COMBINING_MARKS = "".join(chr(code) for code in range(0x0300, 0x0370))


@functools.cache
def accent_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic lower-case letters and the letter under the accent.

    Derived from the canonical decompositions of Unicode: one base letter
    followed by combining marks only.
    """
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)):
        char = chr(code)
        base, *marks = unicodedata.normalize("NFD", char)
        if marks and all(unicodedata.combining(m) for m in marks) and char == char.lower():
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold(c: Column) -> Column:
    """Lower-case without accents."""
    accented, plain = accent_table()
    # Marks without a partner in ``plain`` are deleted: text may arrive decomposed.
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(F.lower(c), accented + COMBINING_MARKS, plain)).otherwise(F.lower(c))


def tokenise(c: Column) -> Column:
    """Tokens in order; NULL text has none."""
    tokens = F.regexp_extract_all(fold(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def fold_text(text: str) -> str:
    """``fold`` for a search word on the driver."""
    decomposed = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(m for m in decomposed if not unicodedata.combining(m)))


def _words(text: str) -> list[str]:
    words, current = [], ""
    for char in fold_text(text):
        if unicodedata.category(char)[0] in "LN":
            current += char
        elif current:
            words.append(current)
            current = ""
    return words + ([current] if current else [])


class Expr:
    """A boolean text expression; combine with ``&``, ``|`` and ``without``."""

    def __and__(self, other: Expr) -> Expr:
        return All((self, other))

    def __or__(self, other: Expr) -> Expr:
        return Any_((self, other))

    def without(self, other: Expr) -> Expr:
        return Without(self, other)

    def in_columns(self, *columns: str) -> Expr:
        return Scoped(self, columns)


@dataclass(frozen=True)
class Term(Expr):
    """A word, or several words that must follow each other in one column."""

    text: str

    def words(self) -> list[str]:
        return _words(self.text)


@dataclass(frozen=True)
class All(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Any_(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Without(Expr):
    keep: Expr
    drop: Expr


@dataclass(frozen=True)
class Scoped(Expr):
    """The expression with its terms looked for in these columns only."""

    inner: Expr
    columns: tuple[str, ...]


def _phrase(tokens: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(tokens, words[0])
    # The phrase as text between separators that no token can contain.
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(joined, F.lit(" " + " ".join(words) + " "))


Leaf = Callable[[str, list[str]], Column]


def build(expr: Expr, columns: tuple[str, ...], leaf: Leaf) -> Column:
    """``expr`` as one condition; ``leaf`` says how a column is searched for words in a row."""
    if isinstance(expr, Term):
        words = expr.words()
        found = F.lit(False)
        for column in columns if words else ():
            found = found | leaf(column, words)
        return found
    if isinstance(expr, Scoped):
        return build(expr.inner, tuple(c for c in columns if c in expr.columns), leaf)
    if isinstance(expr, Without):
        return build(expr.keep, columns, leaf) & ~build(expr.drop, columns, leaf)
    if isinstance(expr, All):
        return functools.reduce(lambda a, b: a & b, [build(p, columns, leaf) for p in expr.parts])
    if isinstance(expr, Any_):
        return functools.reduce(lambda a, b: a | b, [build(p, columns, leaf) for p in expr.parts])
    raise TypeError(f"not a text expression: {expr!r}")


def match_tokens(expr: Expr, tokens: dict[str, Column]) -> Column:
    """``expr`` over ready-made token arrays, one per searchable column."""
    return build(expr, tuple(tokens), lambda c, words: _phrase(tokens[c], words))


@functools.cache
def letter_variants() -> dict[str, str]:
    """Folded letter -> every other character that folds to it alone."""
    variants: dict[str, str] = {}
    accented = {*range(0x41, 0x530), *range(0x1E00, 0x2000), 0x212A, 0x212B}
    for code in range(0x41, sys.maxunicode + 1):
        char = chr(code)
        folded = fold_text(char) if code in accented else char.lower()
        if folded != char and len(folded) == 1 and unicodedata.category(char)[0] == "L":
            variants[folded] = variants.get(folded, "") + char
    return variants


def phrase_pattern(words: list[str]) -> str:
    """A regular expression that finds the words as adjacent tokens in unfolded text.

    Every letter stands for all its cases and accents, combining marks may follow
    it, and no letter or digit may touch the words: they begin the text or come
    after something else than a letter, a digit or a mark, with any number of marks between.
    """
    marks, solid = r"[\x{300}-\x{36f}]*+", r"[\p{L}\p{N}]"

    def letter(char: str) -> str:
        near = [c for c in char + letter_variants().get(char, "") if ord(c) < 256]
        far = [c for c in char + letter_variants().get(char, "") if ord(c) >= 256]
        listed = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
        # The many far variants behind a range test: most characters fail it at once.
        behind = f"[\\x{{100}}-\\x{{10ffff}}&&[{listed(far)}]]" if far else ""
        return f"[{listed(near)}{behind}]"

    texts = ["".join(letter(c) + marks for c in word) for word in words]
    texts[0] = r"(?:\A|[^\p{L}\p{N}\x{300}-\x{36f}])" + marks + texts[0]
    return f"[^\\p{{L}}\\p{{N}}]++".join(texts) + f"(?!{solid})"


def match_text(expr: Expr, columns: tuple[str, ...]) -> Column:
    """``expr`` over text columns themselves: one pass of a pattern per term, nothing is tokenised."""
    return build(expr, columns, lambda c, words: F.coalesce(F.col(c).rlike(phrase_pattern(words)), F.lit(False)))


def _all_words(expr: Expr) -> list[str]:
    if isinstance(expr, Term):
        return expr.words()
    if isinstance(expr, Scoped):
        return _all_words(expr.inner)
    parts = (expr.keep, expr.drop) if isinstance(expr, Without) else expr.parts
    return [w for p in parts for w in _all_words(p)]


def used_columns(expr: Expr, columns: tuple[str, ...]) -> tuple[str, ...]:
    """The columns an expression looks into, so only those are read and tokenised."""
    if isinstance(expr, Term):
        return columns
    if isinstance(expr, Scoped):
        return used_columns(expr.inner, tuple(c for c in columns if c in expr.columns))
    parts = (expr.keep, expr.drop) if isinstance(expr, Without) else expr.parts
    used = {c for p in parts for c in used_columns(p, columns)}
    return tuple(c for c in columns if c in used)


def text_match(df: DataFrame, expr: Expr, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose text satisfies the expression.

    Patterns run on the text as it is. The case of a Greek sigma depends on its
    place in the word, so expressions with one go by tokens instead.
    """
    if not any(c in "σς" for word in _all_words(expr) for c in word):
        return df.filter(match_text(expr, columns))
    used = used_columns(expr, columns)
    names = {c: f"_tok_{i}" for i, c in enumerate(used)}
    tokened = df.select("*", *[tokenise(F.col(c)).alias(n) for c, n in names.items()])
    matched = tokened.filter(match_tokens(expr, {c: F.col(n) for c, n in names.items()}))
    return matched.drop(*names.values())


def text_match_tokens(df: DataFrame, expr: Expr, token_columns: dict[str, str]) -> DataFrame:
    """As ``text_match`` where token arrays are already stored: ``{column: its token column}``."""
    return df.filter(match_tokens(expr, {c: F.col(n) for c, n in token_columns.items()}))
