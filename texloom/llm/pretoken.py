"""Splitting text before byte-level merges, and counts of tokens by overlapping chunks."""

from __future__ import annotations

import re

import regex

# The white space of Unicode; spelled out since regex engines disagree about the separators 1C to 1F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letters: str, numbers: str, space: str) -> str:
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


# Up to U+024F the classes are short enough for the standard library, which is twice as fast.
_LATIN = re.compile(_pattern("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \\x85\\xa0"))
_BEYOND = re.compile("[^\0-ɏ]")
_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}", SPACE))


def pattern_for(text: str):
    return _LATIN if text.isascii() or not _BEYOND.search(text) else _ANY


def pieces(text: str) -> list[str]:
    """The matches of the public pattern, in order; together they are the whole text."""
    return pattern_for(text).findall(text)
