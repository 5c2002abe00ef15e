"""Canonical text, class names, tokens and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textassay.functions.patterns import TOKEN

# The label domain of the corpus.
CLASS_NAMES = {1: "World", 2: "Sports", 3: "Business", 4: "Sci-Tech"}

# Every character that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MIN_TRAINING_LENGTH = 100
MAX_REQUEST_LENGTH = 5000


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column) -> Column:
    """Remove Unicode whitespace at both ends (``F.trim`` alone knows U+0020)."""
    return F.trim(value, F.lit(WHITESPACE))


def build_text(title: Column, description: Column, stripped: bool = True) -> Column:
    """Title, one space, description; a null field counts as empty."""
    parts = [F.coalesce(part, F.lit("")) for part in (title, description)]
    if stripped:
        parts = [strip(part) for part in parts]
    return F.concat(parts[0], F.lit(" "), parts[1])


def class_name(label: Column, names: dict[int, str] = CLASS_NAMES) -> Column:
    """Name of a label; null outside the domain."""
    chain = F.lit(None).cast("string")
    for value, name in sorted(names.items(), reverse=True):
        chain = F.when(label == value, name).otherwise(chain)
    return chain


def tokens(text: Column, lowercase: bool = True) -> Column:
    """Runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN), F.lit(0))


def input_flags(text: Column, min_length: int = MIN_TRAINING_LENGTH,
                max_length: int = MAX_REQUEST_LENGTH) -> dict[str, Column]:
    """Flags for scoring: short rows are flagged, only empty or huge ones rejected."""
    length = F.char_length(text)
    return {
        "below_training_length_floor": length < min_length,
        "rejected": (length == 0) | (length > max_length),
    }


def title_line(document: Column) -> Column:
    """First line of a document."""
    return F.substring_index(document, "\n", 1)


def body_lines(document: Column) -> Column:
    """Everything after the first line; empty when there is one line only."""
    return F.substring(document, F.char_length(title_line(document)) + 2, F.char_length(document))
