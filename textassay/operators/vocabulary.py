"""Terms, document frequencies, weights and vocabulary differences.

Term tables stay long, ``(id, term, ...)``, so no vocabulary passes through the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions.numbers import share
from textassay.functions.text import input_flags, tokens, with_value
from textassay.operators.keyed import join_by_frequency
from textassay.session import broadcast_checked, settle


def terms(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per distinct term of a row."""
    return df.select(*(["doc_id"] if keep is None else keep), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def counted_tokens(text: Column) -> Column:
    """Array of (term, tf) of a text's tokens."""
    return counted(tokens(text))


def word_pairs(words: Column) -> Column:
    """Each two neighbours of an array of words, joined by a space."""
    return with_value(words, lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda word, i: F.concat_ws(" ", word, F.get(w, i + 1))
    ))


def counted(terms: Column) -> Column:
    """Array of (term, tf), built inside the row so that counting shuffles nothing.

    Terms are sorted; the start of each run of equal terms is kept, and a run
    ends where the next one starts.
    """
    def runs(ordered):
        placed = F.transform(ordered, lambda term, i: F.struct(term.alias("term"), i.alias("i")))
        starts = F.filter(placed, lambda run: (run["i"] == 0) | (run["term"] != F.get(ordered, run["i"] - 1)))
        return with_value(starts, lambda runs: F.transform(runs, lambda run, k: F.struct(
            run["term"].alias("term"),
            (F.coalesce(F.get(runs, k + 1)["i"], F.size(ordered)) - run["i"]).alias("tf"),
        )))

    return with_value(F.sort_array(terms), runs)


def term_counts(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Term frequency per row, long."""
    return df.select(row_id, F.inline(counted_tokens(F.col(text))))


def document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that contain each term."""
    return terms(df, text, []).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary_size(df: DataFrame, groups: list[str], text: str = "text") -> DataFrame:
    """Distinct terms per group, as a fitted vectorizer would hold."""
    return terms(df, text, groups).groupBy(*groups, "term").agg(F.count("*").alias("df")).groupBy(*groups).agg(
        F.count("*").alias("vocab_size")
    )


def vocabulary_difference(df: DataFrame, before: str = "text", after: str = "repaired") -> DataFrame:
    """Terms lost and terms gained, listed apart; a net figure hides one of them.

    Both variants sit on one row. A row sends each of its terms on once, marked as
    kept, lost or gained there, and one aggregation decides for the corpus.
    """
    both = df.select(
        F.array_distinct(tokens(F.col(before))).alias("b"), F.array_distinct(tokens(F.col(after))).alias("a")
    )
    marked = F.array(*[
        F.struct(F.lit(in_before).alias("in_before"), F.lit(in_after).alias("in_after"), some.alias("t"))
        for in_before, in_after, some in (
            (1, 1, F.array_intersect("b", "a")), (1, 0, F.array_except("b", "a")), (0, 1, F.array_except("a", "b")),
        )
    ])
    seen = (
        both.select(F.inline(marked)).select("in_before", "in_after", F.explode("t").alias("term"))
        .groupBy("term").agg(F.sum("in_before").alias("df_before"), F.sum("in_after").alias("df_after"))
    )
    return seen.filter((F.col("df_before") == 0) | (F.col("df_after") == 0)).select(
        "term", F.when(F.col("df_after") == 0, "lost").otherwise("gained").alias("direction"),
        (F.col("df_before") + F.col("df_after")).alias("df"),
    )


def smooth_idf(n_rows: Column, df: Column) -> Column:
    """``ln((1+n)/(1+df)) + 1``."""
    return F.log((1 + n_rows) / (1 + df)) + 1


def tfidf(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """L2-normalised smooth TF-IDF as a long table; the vocabulary is not truncated."""
    counts = term_counts(df, text, row_id)
    frequencies = settle(counts.groupBy("term").agg(F.count("*").alias("df")))
    size = df.agg(F.count("*").alias("n_rows"))
    weighted = join_by_frequency(counts, frequencies, "term", "df", row_id).join(F.broadcast(size)).withColumn(
        "w", F.col("tf") * smooth_idf(F.col("n_rows"), F.col("df"))
    )
    norm = Window.partitionBy(row_id)
    return weighted.select(
        row_id, "term", "tf", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight")
    )


def class_log_odds(df: DataFrame, text: str = "text", column: str = "class_name") -> DataFrame:
    """Smoothed log-odds of a term's rows in one class against all others."""
    per_class = terms(df, text, [column]).groupBy("term", column).agg(F.count("*").alias("n_in"))
    sizes = df.groupBy(column).agg(F.count("*").alias("rows_in"))
    both = Window.partitionBy("term")
    # One row per class; the caller names the column, so its size is checked.
    sizes = broadcast_checked(settle(sizes.join(F.broadcast(df.agg(F.count("*").alias("rows_all"))))))

    def log_odds(hits, rows):
        return F.log((hits + 0.5) / (rows - hits + 0.5))

    return (
        per_class.withColumn("n_all", F.sum("n_in").over(both)).join(sizes, column)
        .withColumn("log_odds", log_odds(F.col("n_in"), F.col("rows_in"))
                    - log_odds(F.col("n_all") - F.col("n_in"), F.col("rows_all") - F.col("rows_in")))
        .select("term", column, "n_in", "n_all", "log_odds")
    )


def out_of_vocabulary(df: DataFrame, known: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Share of a row's tokens that training never saw, with the length flags.

    ``known`` has one row per training ``term``. A row without tokens has a null
    share.
    """
    counts = term_counts(df, text, row_id)
    frequencies = settle(
        counts.groupBy("term").agg(F.count("*").alias("df"))
        .join(known.select("term", F.lit(True).alias("known")), "term", "left")
    )
    per_row = join_by_frequency(counts, frequencies, "term", "df", row_id).groupBy(row_id).agg(
        F.sum("tf").alias("n_tokens"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("tf"))).alias("n_unknown"),
    )
    flags = input_flags(F.col(text))
    rows = df.select(row_id, *[flag.alias(name) for name, flag in flags.items()])
    zero = F.lit(0).cast("bigint")
    return rows.join(per_row, row_id, "left").withColumns({
        "n_tokens": F.coalesce("n_tokens", zero),
        "n_unknown": F.coalesce("n_unknown", zero),
        "oov_fraction": share(F.col("n_unknown"), F.col("n_tokens")),
    })
