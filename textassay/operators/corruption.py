"""Corruption counts. Counts come first; a rate is always count over count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions import patterns
from textassay.functions.numbers import share, wilson
from textassay.functions.text import build_text


def pattern_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows per pattern and the share of ROWS, all patterns in one scan."""
    hits = {name: F.count_if(rule(F.col(text))) for name, rule in patterns.PREDICATES.items()}
    one = df.agg(F.count("*").alias("n_rows"), *[hit.alias(name) for name, hit in hits.items()])
    return one.unpivot(["n_rows"], list(hits), "pattern", "n_hits").select(
        "pattern", "n_hits", "n_rows", share(F.col("n_hits"), F.col("n_rows")).alias("row_share")
    )


def rate_by_class(df: DataFrame, hit: Column, column: str = "class_name") -> DataFrame:
    """Rows, hits and rate per class."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("n_hits"))
        .withColumn("rate", share(F.col("n_hits"), F.col("n_rows")))
    )


def with_interval(rates: DataFrame) -> DataFrame:
    """Wilson interval next to a rate."""
    low, high = wilson(F.col("n_hits"), F.col("n_rows"))
    return rates.withColumns({"low": low, "high": high})


def provenance_grid(df: DataFrame) -> DataFrame:
    """Hits for strip on/off x canonical/loose pattern, in one scan."""
    cells = []
    for stripped in (True, False):
        text = build_text(F.col("title"), F.col("description"), stripped)
        for name, rule in (("canonical", patterns.corrupt), ("loose", patterns.loose_corrupt)):
            cells.append((stripped, name, F.count_if(rule(text))))
    one = df.agg(*[cell.alias(f"c{i}") for i, (_, _, cell) in enumerate(cells)])
    rows = [
        F.struct(F.lit(stripped).alias("stripped"), F.lit(name).alias("pattern"), F.col(f"c{i}").alias("n_hits"))
        for i, (stripped, name, _) in enumerate(cells)
    ]
    return one.select(F.inline(F.array(*rows)))


def reproduces(grid: DataFrame, expected: int) -> DataFrame:
    """Mark the text definitions whose canonical count equals a published total."""
    return grid.filter(F.col("pattern") == "canonical").withColumn(
        "reproduces", F.col("n_hits") == expected
    )


def loose_only(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that only the pattern without the word boundary matches."""
    return df.filter(patterns.loose_corrupt(F.col(text)) & ~patterns.corrupt(F.col(text)))


def markup_report(df: DataFrame, text: str = "text", column: str = "class_name") -> DataFrame:
    """Markup rows, also-intact rows, rate per class and the spread of the rates."""
    s = F.col(text)
    per_class = df.groupBy(column).agg(
        F.count("*").alias("n_rows"),
        F.count_if(patterns.markup(s)).alias("n_markup"),
        F.count_if(patterns.markup(s) & patterns.intact(s)).alias("n_also_intact"),
    ).withColumn("rate", share(F.col("n_markup"), F.col("n_rows")))
    # One window over one row per class: the texts are scanned once.
    every = Window.partitionBy(F.lit(0))
    return per_class.withColumns({
        "all_rows": F.sum("n_rows").over(every),
        "all_markup": F.sum("n_markup").over(every),
        "spread": share(F.max("rate").over(every), F.min("rate").over(every)),
    })


def entity_numbers(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per numeric entity OCCURRENCE."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"#(\p{Nd}{2,4});"), F.lit(1))
    return df.filter(patterns.bare_num(F.col(text))).select(F.explode(found).alias("codepoint"))


def entity_census(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences per entity number, as written (``038`` is not ``38``)."""
    return entity_numbers(df, text).groupBy("codepoint").agg(F.count("*").alias("occurrences"))


def unrepaired_census(df: DataFrame, repaired: str = "repaired") -> DataFrame:
    """Entity numbers that are counted as corruption and survive the repair."""
    return entity_census(df, repaired)


def row_and_occurrence_share(df: DataFrame, number: str, text: str = "text") -> DataFrame:
    """How much one entity matters, by rows and by occurrences, kept apart."""
    s = F.col(text)
    numbers = F.regexp_extract_all(s, F.lit(r"#(\p{Nd}{2,4});"), F.lit(1))
    of_interest = F.size(F.filter(numbers, lambda x: x == number))
    return df.filter(patterns.corrupt(s)).agg(
        F.count_if(F.contains(s, F.lit(f"#{number};"))).alias("rows_with_entity"),
        F.count("*").alias("corrupt_rows"),
        F.coalesce(F.sum(of_interest), F.lit(0)).alias("entity_occurrences"),
        F.coalesce(F.sum(F.size(numbers)), F.lit(0)).alias("numeric_occurrences"),
    ).withColumns({
        "share_of_rows": share(F.col("rows_with_entity"), F.col("corrupt_rows")),
        "share_of_occurrences": share(F.col("entity_occurrences"), F.col("numeric_occurrences")),
    })


def widest_skew(rates: DataFrame, column: str = "class_name") -> DataFrame:
    """The two classes whose rates lie furthest apart."""
    low = F.min(F.struct("rate", column)).alias("low")
    high = F.max(F.struct("rate", column)).alias("high")
    return rates.agg(low, high).select(
        F.col(f"low.{column}").alias("low_class"),
        F.col(f"high.{column}").alias("high_class"),
        (F.col("high.rate") - F.col("low.rate")).alias("skew"),
    )
