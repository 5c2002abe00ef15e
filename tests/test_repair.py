"""Repair and unescape against values that follow from the definition."""

from __future__ import annotations

import html
import random
from html.entities import html5

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textassay.functions import patterns, repair, text

REPAIRS = [
    ("Ch #225;vez", "Chávez"),
    ("Congr #232;s", "Congrès"),
    ("r #233;sum #233;", "résumé"),
    ("f #234;te", "fête"),
    ("the Ch #225;vez government", "the Chávez government"),
    ("Street #39;s", "Street's"),
    ("a gt; b", "a> b"),
    ("AT&amp;T", "AT&T"),
    ("Street&#39;s", "Street's"),
    ("Yankees beat Red Sox 5-3 in extra innings.", "Yankees beat Red Sox 5-3 in extra innings."),
    ("wearing #7; tonight", "wearing #7; tonight"),
    ("a  gt; b", "a > b"),
    ("&amp;lt;", "&<"),
    ("&amp;#39;", "&'"),
    ("salt; clamp;", "salt; clamp;"),
    ("1 #39;s", "1's"),
    ("#151;", "—"),
    ("x #0151; y", "x #0151; y"),
    ("&copy 2024", "© 2024"),
    ("&#x27;", "'"),
    ("&notit;", "¬it;"),
    ("&#0;", "�"),
    ("&zzz;", "&zzz;"),
    ("", ""),
    (None, None),
]
GAP = ["038", "0151", "91", "93", "8211", "8212", "8217", "8220", "8221", "8364", "8482"]


def apply(spark, values, *functions):
    """Rows in order, one column per function."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(4)
    rows = df.select("i", *[f(F.col("s")).alias(f"c{k}") for k, f in enumerate(functions)]).collect()
    return [tuple(row)[1:] for row in sorted(rows, key=lambda row: row.i)]


def test_repair_cases(spark):
    got = apply(spark, [dirty for dirty, _ in REPAIRS], repair.repair)
    assert [row[0] for row in got] == [clean for _, clean in REPAIRS]


def test_repair_twice_changes_nothing_for_bare_entities(spark):
    row = apply(spark, ["Ch #225;vez said gt; #39;no #39;"], repair.repair,
                lambda c: repair.repair(repair.repair(c)))[0]
    assert row[0] == row[1]


def test_gap_is_counted_but_not_repaired(spark):
    values = [f"x #{cp}; y" for cp in GAP]
    for value, (hit, fixed, left) in zip(values, apply(
            spark, values, patterns.corrupt, repair.repair,
            lambda c: patterns.unrepaired(repair.repair(c)))):
        assert hit and left and fixed == value


def test_unescape_equals_the_standard_library(spark):
    @F.pandas_udf("string")
    def unescape_arrow(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    rng = random.Random(7)
    values = ["&" + name for name in html5]
    values += ["&" + name[:-1] + "x;y" for name in html5 if len(name) > 2]
    numbers = list(range(0, 300)) + [0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600,
                                     0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**12, 10**30, 64257]
    for n in numbers:
        values += [f"a&#{n};b", f"a&#{n} b", f"&#x{n:x};", f"&#X{n:X}g", f"&#000{n};", f"&#x000{n:x}z"]
    alphabet = ["&", "#", "x", "X", ";", "3", "9", "amp", "lt", "not", "in", "copy", " ", "\n", "<", "é", "&&", "&#"]
    values += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    got = apply(spark, values, repair.unescape, unescape_arrow)
    wrong = [(v, g, html.unescape(v)) for v, g in zip(values, got)
             if g[0] != html.unescape(v) or g[1] != html.unescape(v)]
    assert not wrong, wrong[:5]


PREDICATE_ROWS = [
    ("&lt;strong&gt;", (False, True, True, True, True, True)),
    ("Hamas Camp; 13 Are Killed", (False, False, False, False, False, True)),
    ("salt; clamp;", (False, False, False, False, False, True)),
    ("x #64257; y", (False, False, False, False, False, False)),
    ("&lt; /b", (False, True, True, True, True, True)),
    ("élt; x", (False, False, False, False, False, True)),
    ("#39;s", (True, False, False, True, False, True)),
]


@pytest.mark.parametrize("value, expected", PREDICATE_ROWS)
def test_predicates(spark, value, expected):
    names = ["bare_num", "bare_named", "intact", "any_bare", "markup", "loose"]
    got = apply(spark, [value], *[patterns.PREDICATES[name] for name in names])[0]
    assert got == expected


def test_tokens(spark):
    rows = [
        (apply(spark, ["Last season #39;s UEFA"], lambda c: text.tokens(repair.repair(c)))[0][0],
         ["last", "season", "uefa"]),
        (apply(spark, ["Last season #39;s UEFA"], text.tokens)[0][0], ["last", "season", "39", "uefa"]),
        (apply(spark, ["Chávez résumé naïve season's a 39 ávez"], text.tokens)[0][0],
         ["chávez", "résumé", "naïve", "season", "39", "ávez"]),
    ]
    for got, expected in rows:
        assert got == expected


def test_strip_removes_every_unicode_space(spark):
    values = [" \t x y \n", "\u2003x\u00a0", "\x1cq\x85", "", "   ", None]
    got = apply(spark, values, text.strip)
    assert [row[0] for row in got] == [None if v is None else v.strip() for v in values]


def test_build_text_and_class_name(spark):
    df = spark.createDataFrame([(1, " a ", "\tb"), (4, None, "NA"), (9, "", "x")], "label int, t string, d string")
    rows = df.select(
        text.build_text(F.col("t"), F.col("d")).alias("s"),
        text.build_text(F.col("t"), F.col("d"), stripped=False).alias("u"),
        text.class_name(F.col("label")).alias("c"),
    ).collect()
    assert [r.s for r in rows] == ["a b", " NA", " x"]
    assert rows[0].u == " a  \tb"
    assert [r.c for r in rows] == ["World", "Sci-Tech", None]


def test_whole_word_with_case_flag(spark):
    got = apply(spark, ["AMP x", "amp x", "ampx", "éamp"],
                lambda c: patterns.has_word(c, "amp"),
                lambda c: patterns.has_word(c, "amp", case_sensitive=False))
    assert got == [(False, True), (True, True), (False, False), (False, False)]


def test_strip_markup_and_body(spark):
    row = apply(spark, ["<b>hi</b> 2 < 3\nsecond\nthird"], repair.strip_markup, text.title_line, text.body_lines)[0]
    assert row == (" hi  2 < 3\nsecond\nthird", "<b>hi</b> 2 < 3", "second\nthird")


def test_repair_of_one_number(spark):
    row = apply(spark, ["Street #39;s gt; #36;5&#39;"], lambda c: repair.repair_number(c, 39))[0]
    assert row == ("Street's gt; #36;5'",)


def test_decimal_references_at_the_edge_of_the_list(spark):
    cases = [f"a&#{n}{end}z" for n in (*range(0, 300), 998, 999, 1000, 1001, 8211) for end in (";", "")]
    cases += ["&#000000065;", "&#0000000000000000065;x", "&#99999999999999;", "&#2147483648;", "&#4294967361;", "&#x41;", "&#;", "&#+5;", "&# 5;", "&#65 ;", "&#65;&#66;&amp;#67;"]
    rows = spark.createDataFrame([(c,) for c in cases], "s STRING").select("s", repair.unescape(F.col("s")).alias("u")).collect()
    assert [r.u for r in rows] == [html.unescape(r.s) for r in rows]
