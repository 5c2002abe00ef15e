"""Entity-corruption predicates, as ``Column -> Column`` functions.

Every counting pattern is written once here and used everywhere else. The
character classes are spelled out because ``\\w``, ``\\b`` and ``\\d`` are ASCII
in Java and in RE2 but Unicode where the published counts come from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns behind the published counts.
ENTITY_NAMES = ("lt", "gt", "quot", "amp", "nbsp", "apos")
NAMES_ALT = "|".join(ENTITY_NAMES)
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"
BARE_NUM = r"#\p{Nd}{2,4};"
BARE_NAMED = NOT_WORD_BEFORE + "(?:" + NAMES_ALT + ");"
BARE_NAMED_LOOSE = "(?:" + NAMES_ALT + ");"
INTACT = r"&(?:#\p{Nd}+|[\p{L}\p{N}_]+);"
MARKUP = r"&lt;[\s\p{Z}\x1c-\x1f\x85]*/?[A-Za-z]"
TAG = r"<\s*/?[A-Za-z][^>]*>"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _found(text: Column, needle: str, pattern: str) -> Column:
    # A plain substring test in front spares clean rows the regex engine.
    return F.contains(text, F.lit(needle)) & text.rlike(pattern)


def bare_num(text: Column) -> Column:
    """A numeric entity, with or without its ampersand."""
    return _found(text, ";", BARE_NUM)


def bare_named(text: Column) -> Column:
    """A named entity at a word boundary; matches intact ``&lt;`` as well."""
    return _found(text, ";", BARE_NAMED)


def intact(text: Column) -> Column:
    """An entity that still has its ampersand."""
    return _found(text, "&", INTACT)


def corrupt(text: Column) -> Column:
    """The canonical per-row corruption flag."""
    return _found(text, ";", BARE_NUM + "|" + BARE_NAMED)


def loose_corrupt(text: Column) -> Column:
    """The corruption flag without the word boundary (``Camp;`` matches)."""
    return _found(text, ";", BARE_NUM + "|" + BARE_NAMED_LOOSE)


def markup(text: Column) -> Column:
    """Escaped markup such as ``&lt;strong`` or ``&lt;/A``."""
    return _found(text, "&lt;", MARKUP)


PREDICATES = {
    "bare_num": bare_num,
    "bare_named": bare_named,
    "intact": intact,
    "any_bare": corrupt,
    "markup": markup,
    "loose": loose_corrupt,
}


def has_word(text: Column, token: str, case_sensitive: bool = True) -> Column:
    """Whole-word containment of one alphanumeric token."""
    flags = "" if case_sensitive else "(?iu)"
    return text.rlike(flags + NOT_WORD_BEFORE + token + NOT_WORD_AFTER)


def unrepaired(repaired: Column) -> Column:
    """Counted as corrupt, yet still there after the repair."""
    return bare_num(repaired)
