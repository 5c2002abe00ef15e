"""Entity repair: put dropped ampersands back, then unescape once.

All of it stays in the JVM. ``unescape`` follows the HTML5 rules for character
references as Spark expressions; its name tables come from the standard
library's ``html.entities`` and its Windows-1252 row from the codec, so no table
is written out here.
"""

from __future__ import annotations

import json
from html import unescape as unescaped
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textassay.functions.patterns import NAMES_ALT, TAG
from textassay.functions.text import with_value

# The numbers that are repaired are 30-39 and 100-299. The
# ampersand was replaced by one space, so one space is consumed, and an entity
# that still has its ampersand does not get a second one.
# The look back comes after the entity, so it runs only where there is one.
NUMERIC_REPAIR = r" ?#(?<!&#)((?:3[0-9]|1[0-9]{2}|2[0-9]{2});)"
NAMED_REPAIR = r" ?((?:" + NAMES_ALT + r");)(?<![&\p{L}\p{N}_](?:" + NAMES_ALT + r");)"
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

REPLACEMENT_CHARACTER = "\ufffd"
LAST_CODEPOINT = 0x10FFFF
# Decimal references below this number are looked up by place; the rules are for all others.
LISTED = 1_000


def restore_numeric(text: Column) -> Column:
    """``Ch #225;vez`` becomes ``Ch&#225;vez``."""
    return F.regexp_replace(text, NUMERIC_REPAIR, "&#$1")


def restore_named(text: Column) -> Column:
    """``a gt; b`` becomes ``a&gt; b``."""
    return F.regexp_replace(text, NAMED_REPAIR, "&$1")


def _codepoint_to_char(number: Column) -> Column:
    """One character from its codepoint (``F.char`` is modulo 256)."""
    packed = F.unhex(F.lpad(F.hex(number), 8, "0"))
    # The UTF-32 decoder reads U+FEFF as a byte-order mark and drops it.
    return F.when(number == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(packed, "UTF-32"))


def _digits(ref: Column) -> Column:
    """Codepoint of ``#38;`` or ``#x26``; one past the last for anything longer."""
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    hex_digits = F.regexp_extract(ref, r"^#[xX]0*([0-9a-fA-F]*)", 1)
    decimal_digits = F.regexp_extract(ref, r"^#0*([0-9]*)", 1)

    def number(digits: Column, most: int, base: int) -> Column:
        # ``most`` significant digits hold every codepoint.
        return with_value(digits, lambda d: F.when(d == "", 0).when(
            F.char_length(d) > most, LAST_CODEPOINT + 1
        ).otherwise(F.conv(d, base, 10).cast("int")))

    return F.when(is_hex, number(hex_digits, 6, 16)).otherwise(number(decimal_digits, 7, 10))


def _numeric_reference(ref: Column) -> Column:
    """Text of a numeric reference: cp1252 for the C1 range, U+FFFD if invalid."""
    c1_row = [bytes([value]).decode("cp1252", "ignore") or chr(value) for value in range(0x80, 0xA0)]

    def character(number: Column) -> Column:
        surrogate = number.between(0xD800, 0xDFFF)
        dropped = (
            number.between(0x1, 0x8)
            | number.between(0xE, 0x1F)
            | number.between(0xFDD0, 0xFDEF)
            | number.isin(0xB, 0x7F)
            | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        return (
            F.when((number == 0) | surrogate | (number > LAST_CODEPOINT), REPLACEMENT_CHARACTER)
            .when(number.between(0x80, 0x9F), F.substring(F.lit("".join(c1_row)), number - 0x7F, F.lit(1)))
            .when(dropped, "")
            .otherwise(_codepoint_to_char(number))
        )

    # The JSON text folds to one array literal; a reference in hex, or beyond any integer, has no place in it.
    listed = F.from_json(F.lit(json.dumps([unescaped(f"&#{number};") for number in range(LISTED)])), "array<string>")
    place = F.rtrim(F.substring(ref, F.lit(2), F.char_length(ref)), F.lit(";")).try_cast("int")
    return F.coalesce(F.get(listed, place), with_value(_digits(ref), character))


def _lookup(table: dict[str, str], key: Column) -> Column:
    # The JSON text folds to one map literal when the plan is optimised.
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def _named_reference(ref: Column) -> Column:
    """Text of ``copy;``, or of a name without ``;`` by its longest known prefix."""
    common = {name: html5[name] for name in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")}
    bare = {name: value for name, value in html5.items() if not name.endswith(";")}
    by_length = sorted(bare, key=lambda name: (-len(name), name))
    prefix = F.regexp_extract(ref, "^(" + "|".join(by_length) + ")", 1)
    by_prefix = F.when(
        prefix != "",
        F.concat(_lookup(bare, prefix), F.substring(ref, F.char_length(prefix) + 1, F.char_length(ref))),
    )
    whole = F.when(F.endswith(ref, F.lit(";")), F.coalesce(_lookup(common, ref), _lookup(html5, ref)))
    return F.coalesce(whole, by_prefix, F.concat(F.lit("&"), ref))


def _after_ampersand(piece: Column) -> Column:
    def decoded(ref: Column) -> Column:
        value = F.when(F.startswith(ref, F.lit("#")), _numeric_reference(ref)).otherwise(_named_reference(ref))
        rest = F.substring(piece, F.char_length(ref) + 1, F.char_length(piece))
        return F.when(ref == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(value, rest))

    return with_value(F.regexp_extract(piece, REFERENCE, 1), decoded)


def unescape(text: Column) -> Column:
    """HTML unescape, once. Rows without ``&`` pass through untouched."""
    def joined(pieces: Column) -> Column:
        others = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(others, _after_ampersand), ""))

    return F.when(F.contains(text, F.lit("&")), with_value(F.split(text, "&"), joined)).otherwise(text)


def repair(text: Column) -> Column:
    """Numeric pass, named pass, one unescape, in that order."""
    restored = F.when(
        F.contains(text, F.lit(";")), restore_named(restore_numeric(text))
    ).otherwise(text)
    return with_value(restored, unescape)


def repair_number(text: Column, number: int) -> Column:
    """Repair one numeric entity and nothing else."""
    restored = F.regexp_replace(text, rf"( ?)(?<!&)(#{number};)", "&$2")
    return F.replace(restored, F.lit(f"&#{number};"), F.lit(chr(number)))


def strip_markup(repaired: Column) -> Column:
    """Replace tags by a space; the variant for text that holds unescaped markup."""
    return F.regexp_replace(repaired, TAG, " ")
