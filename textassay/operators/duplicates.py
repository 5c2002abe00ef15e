"""Duplicate titles in three units, head share and label conflicts.

A title may hold a third of the corpus, so every report works on per-title
aggregates of constant size that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.numbers import share
from textassay.operators.sampling import smallest

# What counts as the tail, how much of it is read, the head size.
TAIL_MAX_COUNT = 3
TAIL_SAMPLE = 40
HEAD_TITLES = 8


def per_title(df: DataFrame, title: str = "title", label: str = "label") -> DataFrame:
    """Count and label range of each title."""
    return df.groupBy(title).agg(
        F.count("*").alias("n"), F.min(label).alias("low_label"), F.max(label).alias("high_label")
    )


def title_units(df: DataFrame, title: str = "title") -> DataFrame:
    """Distinct repeated titles, rows involved, rows beyond the first."""
    repeated = F.col("n") > 1
    return df.groupBy(title).agg(F.count("*").alias("n")).agg(
        F.count_if(repeated).alias("distinct_titles"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("rows_involved"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_beyond_first"),
    )


def head_titles(df: DataFrame, k: int = HEAD_TITLES, title: str = "title") -> DataFrame:
    """The k most frequent titles; ties go by title."""
    counts = df.groupBy(title).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), title).limit(k)


def head_share(df: DataFrame, k: int = HEAD_TITLES, title: str = "title") -> DataFrame:
    """Head occurrences over rows involved: the same unit above and below."""
    head = head_titles(df, k, title).agg(F.sum("n").alias("head_rows"))
    units = title_units(df, title).select("rows_involved")
    # Two frames of exactly one row each.
    return head.join(F.broadcast(units)).withColumn(
        "head_share", share(F.col("head_rows"), F.col("rows_involved"))
    )


def tail_titles(df: DataFrame, max_count: int = TAIL_MAX_COUNT, title: str = "title",
                label: str = "label") -> DataFrame:
    """Titles seen twice up to ``max_count`` times, with their conflict flag."""
    return (
        per_title(df, title, label)
        .filter(F.col("n").between(2, max_count))
        .withColumn("conflict", F.col("low_label") != F.col("high_label"))
    )


def conflict_counts(titles: DataFrame) -> DataFrame:
    """Titles and label conflicts among them. Scope: this selection only."""
    return titles.agg(
        F.count("*").alias("n_titles"), F.count_if("conflict").alias("n_conflicts")
    ).withColumn("conflict_rate", share(F.col("n_conflicts"), F.col("n_titles")))


def tail_conflicts(df: DataFrame, seed: int = 0, sample: int = TAIL_SAMPLE,
                   max_count: int = TAIL_MAX_COUNT, title: str = "title",
                   label: str = "label") -> DataFrame:
    """Label conflicts in a fixed-size sample of the tail."""
    return conflict_counts(smallest(tail_titles(df, max_count, title, label), sample, seed, title))


def beyond_first(df: DataFrame, key: str, row_id: str = "doc_id") -> DataFrame:
    """Rows that repeat the key of a row with a smaller id.

    First rows come from an aggregate and are removed by id: the join key is
    unique, so a key that fills a third of the table does not skew it.
    """
    first = df.groupBy(key).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_anti")
