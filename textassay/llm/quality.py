"""Quality rules: text statistics, two base rules, and robust multivariate outliers.

Minimum-covariance-determinant estimates give centre and scatter of the transformed statistics per
language and source, per language, and over all. A group's estimate is drawn towards its language's, and that
towards the one over all, as if ``PRIOR_ROWS`` documents had been added; so estimates move smoothly with the
size of a group, and no size is treated apart. Documents too far from the centre by Mahalanobis distance go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.common import NOT_SPACE, byte_class, flat, hashes, mix, narrow, runs, slices, sums
from textassay.session import broadcast_checked, settle

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
_SYMBOL = byte_class(SYMBOLS.encode())
# Statistics are drawn towards their group's mean as if this many words, characters or lines of it were added.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50, 300, 10
# Documents that the wider estimate counts for, next to a group's own.
PRIOR_ROWS = 100
# Share of a group that the estimate is fitted to.
SUBSET = 0.75
# Fixed values for five variables: variance of a normal sample over that of its closest 75 %,
# and the chi-square quantile at 1 - 1e-4, beyond which a document is an outlier.
CONSISTENCY, CUTOFF = 1.414, 25.7
# Least standard deviation of each variable: most groups never vary in some of them.
LEAST_SD = (0.05, 0.06, 0.12, 0.12, 0.06)
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "echoes")
# Variables are integers of this fraction, so that sums do not depend on the order of rows.
SCALE = 1 << 14
_BINS_PER_OCTAVE = 32


def _repeats(terms: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Whether each word stands in a window of ``width`` words that its text holds twice or more."""
    marked = np.zeros(len(terms), bool)
    if len(terms) < width:
        return marked
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(terms) - width + 1
    whole = text[:n] == text[width - 1 :]
    h = mix(text[:n].astype(np.uint64))
    for k in range(width):
        h = mix(h ^ terms[k : k + n])
    at = np.flatnonzero(whole)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(width):
        marked[order[twice] + k] = True
    return marked


def _earlier_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier line."""
    newlines = np.flatnonzero(data == 0x0A)
    # A line ends at its newline or where its text ends.
    ends = np.unique(np.concatenate([newlines, offsets[1:] - 1])) if len(data) else np.zeros(0, np.int64)
    ends = ends[ends >= 0]
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    stops = np.where(data[ends] == 0x0A, ends, ends + 1) if len(ends) else ends
    worded = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, starts)
    starts, stops = starts[worded], stops[worded]
    text = np.searchsorted(offsets, starts, "right") - 1
    h = mix(hashes(data, starts, stops) ^ mix(text.astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    later = np.zeros(len(h), bool)
    later[order[1:]] = h[order][1:] == h[order][:-1]
    n = len(offsets) - 1
    return np.bincount(text, minlength=n), np.bincount(text[later], minlength=n)


def statistics(df: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``df``: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_echo_words.

    n_lines are the lines that hold a word, n_echo_words the words equal to the word before them. A null text has no words; all counts are zero.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")

    def task(batches):
        for part in slices(batches, "text", 1 << 20):
            data, offsets = flat(part.column(3))
            solid = NOT_SPACE[data]
            starts, ends = runs(solid, offsets)
            bounds = np.searchsorted(starts, offsets)
            terms = hashes(data, starts, ends)
            repeated = _repeats(terms, bounds, WINDOW)
            echo = np.zeros(len(terms), bool)
            echo[1:] = terms[1:] == terms[:-1]
            echo[bounds[:-1][bounds[:-1] < len(terms)]] = False
            n_lines, n_dup = _earlier_lines(data, offsets, starts)
            values = (
                np.diff(bounds), sums(solid & ((data & 0xC0) != 0x80), offsets), sums(_SYMBOL[data], offsets), n_lines, n_dup,
                sums(repeated, bounds), sums(echo, bounds),
            )
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(x.astype(np.int64)) for x in values)], ["doc_id", "lang", "source", *counts]
            )

    rows = narrow(df, doc_id=row_id, lang=lang, source=source, text=text)
    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in ("doc_id", "lang", "source"))
    return rows.mapInArrow(task, kinds + "".join(f", {name} long" for name in counts))


def base_failed():
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _group(lang, source):
    """A text for the pair of values; null differs from every text."""
    return F.to_json(F.struct(lang.alias("lang"), source.alias("source")))


_MEANS = (("length", "word_chars", "n_words"), ("symbols", "n_symbols", "word_chars"), ("dups", "n_dup_lines", "n_lines"),
          ("repeats", "n_repeat_words", "n_words"), ("echoes", "n_echo_words", "n_words"))
_ALL = "{}"


def _group_means(rows: DataFrame) -> DataFrame:
    """Per group of ``own`` the means that statistics are drawn towards: ``own, m_length, ...``.

    A group's sums are added to ``PRIOR_ROWS`` average documents of its language, whose sums are added to
    as many of all documents. One row per group, a few numbers each.
    """
    sums = rows.filter("not failed").groupBy("own", "of_lang").agg(
        F.count("*").alias("n"), *(F.sum(x).cast("double").alias(x) for x in ("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_echo_words"))
    )
    names = sums.columns[2:]
    sums = settle(sums)
    langs = sums.groupBy("of_lang").agg(*(F.sum(x).alias(f"l_{x}") for x in names))
    whole = sums.agg(*(F.sum(x).alias(f"a_{x}") for x in names))  # one row
    totals = sums.join(langs, "of_lang").join(F.broadcast(whole)).select("own", *(F.col(x).alias(f"g_{x}") for x in names), *langs.columns[1:], *whole.columns)

    def drawn(level, over, under, wider):
        """Ratio of sums, with the wider ratio for PRIOR_ROWS average documents; without any ``under`` the wider one."""
        if wider is None:
            return F.col(f"{level}_{over}") / F.greatest(F.col(f"{level}_{under}"), F.lit(1.0))
        added = PRIOR_ROWS * F.greatest(F.col(f"a_{under}") / F.col("a_n"), F.lit(1e-9))
        return (F.col(f"{level}_{over}") + added * wider) / (F.col(f"{level}_{under}") + added)

    means = []
    for name, over, under in _MEANS:
        value = None
        for level in ("a", "l", "g"):
            value = drawn(level, over, under, value)
        means.append((F.greatest(value, F.lit(1.0)) if name == "length" else value).alias(f"m_{name}"))
    return totals.select("own", *means)


def _vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with ``failed``, ``own`` and ``of_lang`` groups and ``v``, five integers, settled."""
    rows = settle(stats.withColumns({
        "failed": base_failed(), "own": _group(F.col("lang"), F.col("source")), "of_lang": _group(F.col("lang"), F.lit(None).cast("string")),
    }))

    def drawn(over, under, mean, prior):
        return (F.col(over) + prior * F.col(mean)) / (F.col(under) + prior)

    def angle(share):
        return F.asin(F.sqrt(F.least(share, F.lit(1.0))))

    values = F.array(
        F.log(drawn("word_chars", "n_words", "m_length", PRIOR_WORDS)), angle(drawn("n_symbols", "word_chars", "m_symbols", PRIOR_CHARS)),
        angle(drawn("n_dup_lines", "n_lines", "m_dups", PRIOR_LINES)), angle(drawn("n_repeat_words", "n_words", "m_repeats", PRIOR_WORDS)),
        angle(drawn("n_echo_words", "n_words", "m_echoes", PRIOR_WORDS)),
    )
    joined = rows.join(broadcast_checked(settle(_group_means(rows))), "own", "left")
    return settle(joined.select(*rows.columns, F.transform(values, lambda x: F.round(x * SCALE).cast("long")).alias("v")))


def _levels(rows: DataFrame) -> DataFrame:
    """Every vector once for its own group, its language and all: ``group, v``. Levels are marked, so names can't clash."""
    marks = F.array(F.concat(F.lit("g"), "own"), F.concat(F.lit("l"), "of_lang"), F.lit("a" + _ALL))
    return rows.select(F.explode(marks).alias("group"), "v")


def _shrunk(fits: DataFrame, rows: DataFrame) -> DataFrame:
    """Per ``own`` group ``centre`` and ``precision``, drawn from own over language's to all documents' estimate."""
    groups = rows.groupBy("own", "of_lang").agg(F.count("*").alias("n"))
    langs = groups.groupBy("of_lang").agg(F.sum("n").alias("n_lang"))
    fit = F.struct("centre", "precision")
    named = lambda name: fits.select(F.col("group").alias(f"{name}_group"), fit.alias(name))
    joined = groups.join(langs, "of_lang").withColumns({
        "g_group": F.concat(F.lit("g"), "own"), "l_group": F.concat(F.lit("l"), "of_lang"), "a_group": F.lit("a" + _ALL),
    })
    for name in "gla":
        joined = joined.join(named(name), f"{name}_group")
    size = len(FEATURES)

    def shrink(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                centre, scatter = np.array(row.a["centre"]), np.linalg.inv(np.array(row.a["precision"]).reshape(size, size))
                for n, one in ((row.n_lang, row.l), (row.n, row.g)):
                    own = np.linalg.inv(np.array(one["precision"]).reshape(size, size))
                    share, off = n / (n + PRIOR_ROWS), np.array(one["centre"]) - centre
                    # Scatter of a mixture: both scatters, and that of the centres.
                    scatter = share * own + (1 - share) * scatter + share * (1 - share) * np.outer(off, off)
                    centre = centre + share * off
                out.append((row.own, centre.tolist(), np.linalg.inv(scatter).ravel().tolist()))
            yield pd.DataFrame(out, columns=["own", "centre", "precision"])

    return joined.select("own", "n", "n_lang", "g", "l", "a").mapInPandas(shrink, "own string, centre array<double>, precision array<double>")


def _start(rows: DataFrame) -> DataFrame:
    """Per group: centre and precision from medians and quartiles, read off a histogram of each variable."""
    places = rows.select("group", F.posexplode("v").alias("k", "x")).groupBy("group", "k", F.shiftright("x", 5).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group", "k").orderBy("bin")
    whole = Window.partitionBy("group", "k")
    counted = places.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    point = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("all")), (F.col("bin") * 32 + 16) / SCALE))
    quartiles = counted.groupBy("group", "k").agg(point(F.lit(0.25)).alias("a"), point(F.lit(0.5)).alias("b"), point(F.lit(0.75)).alias("c"))
    least = F.array(*map(F.lit, LEAST_SD))
    variance = F.pow((F.col("c") - F.col("a")) / 1.349, 2) + F.pow(F.get(least, F.col("k")), 2)
    listed = quartiles.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "b", variance.alias("s")))).alias("q"))
    size = len(FEATURES)
    precision = F.flatten(F.transform("q", lambda x: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == x["k"], 1 / x["s"]).otherwise(F.lit(0.0))
    )))
    return listed.select("group", F.col("q.b").alias("centre"), precision.alias("precision"), F.lit(float("inf")).alias("spread"), F.lit(False).alias("done"))


def _distance():
    """Squared Mahalanobis distance of ``v`` from ``centre`` under ``precision``, as one expression."""
    size = len(FEATURES)
    off = [F.get("v", F.lit(k)) / SCALE - F.get("centre", F.lit(k)) for k in range(size)]
    total = F.lit(0.0)
    for a in range(size):
        for b in range(size):
            total = total + off[a] * off[b] * F.get("precision", F.lit(size * a + b))
    return F.when(total < 0, F.lit(0.0)).otherwise(total)  # null without an estimate


def _concentrated(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step for every group: mean and scatter of the closest ``SUBSET`` of its rows.

    Rows are summed per bin of distance first; only bins are put in order, so a group of any size
    is one short list. The bin that reaches the subset's size is taken whole.
    """
    size = len(FEATURES)
    v = [F.get("v", F.lit(k)) for k in range(size)]
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    binned = rows.join(broadcast_checked(fits), "group").select(
        "group", F.floor(F.log2(1 + _distance()) * _BINS_PER_OCTAVE).alias("bin"), *(x.alias(f"v{k}") for k, x in enumerate(v))
    )
    summed = binned.groupBy("group", "bin").agg(
        F.count("*").alias("n"), *(F.sum(f"v{k}").alias(f"s{k}") for k in range(size)),
        *(F.sum(F.col(f"v{a}") * F.col(f"v{b}")).alias(f"s{a}_{b}") for a, b in pairs),
    )
    names = ["n", *(f"s{k}" for k in range(size)), *(f"s{a}_{b}" for a, b in pairs)]
    upto, whole = Window.partitionBy("group").orderBy("bin"), Window.partitionBy("group")
    running = summed.select(
        "group", "bin", F.sum("n").over(whole).alias("all"), *(F.sum(F.col(x).cast("decimal(28,0)")).over(upto).alias(x) for x in names)
    )
    reached = running.filter(F.col("n") >= F.ceil(SUBSET * F.col("all"))).groupBy("group").agg(F.min_by(F.struct(*names), "bin").alias("sums"))
    flat_sums = reached.select("group", F.array(*(F.col(f"sums.{x}").cast("double") for x in names)).alias("sums")).join(
        fits.select("group", F.col("centre").alias("old_centre"), F.col("precision").alias("old_precision"), "spread", "done"), "group"
    )

    def fitted(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, first, second = row.sums[0], np.array(row.sums[1 : size + 1]), row.sums[size + 1 :]
                centre = first / n
                scatter = np.zeros((size, size))
                for (a, b), value in zip(pairs, second):
                    scatter[a, b] = scatter[b, a] = value / n - centre[a] * centre[b]
                scatter = scatter / SCALE**2 * CONSISTENCY + np.diag(np.square(LEAST_SD))
                spread = float(np.linalg.slogdet(scatter)[1])
                if row.done or spread >= row.spread - 1e-9:
                    out.append((row.group, list(row.old_centre), list(row.old_precision), row.spread, True))
                else:
                    out.append((row.group, (centre / SCALE).tolist(), np.linalg.inv(scatter).ravel().tolist(), spread, False))
            yield pd.DataFrame(out, columns=["group", "centre", "precision", "spread", "done"])

    return flat_sums.mapInPandas(fitted, "group string, centre array<double>, precision array<double>, spread double, done boolean")


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per group: steps go on until no group's determinant falls."""
    fits = settle(_start(rows))
    while True:
        fits = settle(_concentrated(rows, fits))
        if fits.filter("not done").isEmpty():
            return fits


def judge(df: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``df``: doc_id, the statistics, base_failed, distance and kept.

    distance is the squared Mahalanobis distance from the centre of the document's language and source; a
    document is kept if it passes the base rules and lies within ``CUTOFF``. The estimates use all documents
    that pass the base rules. Null and empty texts fail them; null languages and sources are groups of their
    own; a group of one document is judged by its language's estimate nearly alone. Repeated rows count and are
    judged each. distance is null for documents of groups in which none passes. Other columns are ignored.
    """
    rows = _vectors(statistics(df, row_id, text, lang, source))
    passed = rows.filter("not failed")
    fits = estimates(_levels(passed))
    shrunk = settle(_shrunk(fits, passed))
    far = rows.join(broadcast_checked(shrunk), "own", "left").withColumn("distance", _distance())
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), "distance",
        (~F.col("failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
