"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

LINE = "the quick brown fox jumps over the lazy dog while seven wizards box"
TEXTS = [
    None, "", "   \n\t ", "word", LINE, LINE, LINE + ".", f"{LINE}\n{LINE}\n{LINE}", "naïve café " * 40, "日本語 " * 30, "x" * 60_000,
    " ".join(f"w{k}" for k in range(20_000)), "a " * 5_000, "tail\n", "\nhead", "A'B's don't", "😀" * 30, "tab\tand\x0bform\x0c", LINE[:30] + "é" * 40,
]
# Columns whose names operators use inside.
CLASH = ("segment", "fingerprint", "first", "kept", "digest", "text_", "rule", "row", "group", "v")


def documents(spark, texts=TEXTS, ids=None):
    """A table with one row per text, odd ids among them, and columns with names that clash."""
    ids = ids or [None if k == 2 else k for k in range(len(texts))]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", None if t is None else len(t), *("clash",) * len(CLASH))
            for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{x}` string" for x in CLASH)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark).limit(0)


def by_id(df):
    """Rows as a dictionary; ids in the tests are unique unless null."""
    return {row["doc_id"]: row for row in df.collect()}
