"""Paired, seeded experiments: which text a model is trained on, and which it is tested on.

A run draws one bounded training side per seed and scores every row outside it. All counting models of a
run come from one aggregation, all scores from one join; only the fits of Spark ML's solvers follow one
another on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions.repair import repair_number
from textassay.operators import sampling, scores, vocabulary
from textassay.plans import models
from textassay.session import settle

# Report sizes and the source markers of news text.
CONFIDENT_ERRORS = 50
TOP_TOKENS = 20
SOURCE_MARKERS = r"\(AP\)|\(?Reuters\)?"

Prepare = Callable[[DataFrame], DataFrame] | None


@dataclass(frozen=True)
class Cell:
    """One score: train on one text column, test on another, with settings of the fit."""

    name: str
    train: str
    test: str
    options: dict = field(default_factory=dict, hash=False)


@dataclass
class Run:
    """What a run leaves behind: fitted models, predictions, training sides and one result row per seed and cell."""

    models: models.Models
    predictions: DataFrame
    train: DataFrame
    tokens: DataFrame
    results: DataFrame


def two_by_two(dirty: str = "text", repaired: str = "repaired") -> list[Cell]:
    """The four cells of dirty and repaired."""
    return [Cell("A", dirty, dirty), Cell("B", dirty, repaired), Cell("C", repaired, dirty), Cell("D", repaired, repaired)]


def training_sides(rows: DataFrame, n: int, seeds, row_id: str = "id") -> DataFrame:
    """Settled ``id, seed, step, label``: the training side of a stratified split of n rows drawn per seed."""
    split = sampling.split_samples(rows, n, seeds, row_id=row_id).filter("side = 'train'")
    return settle(split.select(F.col(row_id).alias("id"), "seed", F.lit(0).alias("step"), "label"))


def run(df: DataFrame, cells: list[Cell], labels: list, experiment: str = "run", seeds=sampling.SEEDS, n: int = sampling.N_SAMPLE,
        kind: str = "logistic", row_id: str = "doc_id", prepare: Prepare = None) -> Run:
    """Fit every (training column, settings) once per seed and score all rows outside the training side."""
    spark = df.sparkSession
    rows = settle(df.select(F.col(row_id).alias("id"), "label"))
    columns = sorted({c.removesuffix(models.PAIRS) for cell in cells for c in (cell.train, cell.test)})
    texts = (prepare(df) if prepare else df).select(row_id, *columns)
    tokens = models.long_tokens(texts, sorted({c for cell in cells for c in (cell.train, cell.test)}), row_id)
    train = training_sides(rows, n, seeds, "id")
    wanted = [(cell, seed, models.Fit(cell.train, seed, **{"kind": kind, **cell.options})) for seed in seeds for cell in cells]
    fits = list(dict.fromkeys(one for *_, one in wanted))
    fitted = models.fit(tokens, train, fits, labels)
    asks = [(cell.name, fits.index(one), cell.test) for cell, _, one in wanted]
    predictions = settle(models.predict(fitted, tokens, rows, asks, train))
    sizes = fitted.vocabulary_sizes()
    listed = [(experiment, cell.name, cell.train, cell.test, seed, n, sizes.get(fits.index(one), 0)) for cell, seed, one in wanted]
    about = spark.createDataFrame(listed, "experiment STRING, cell STRING, train STRING, test STRING, seed INT, n INT, vocab_size INT")
    # Fingerprints of the rows each cell was in fact scored on.
    prints = sampling.fingerprint(predictions.select("cell", "seed", "id"), ["cell", "seed"], "id").withColumnRenamed("fingerprint", "test_idx_sha1")
    found = scores.macro_f1(predictions, ["cell", "seed"]).join(prints, ["cell", "seed"])
    results = about.join(found, ["cell", "seed"]).select(
        "experiment", "cell", "train", "test", "seed", "n", "macro_f1", "vocab_size", "test_idx_sha1"
    )
    return Run(fitted, predictions, train, tokens, settle(results))


def check_run(results: DataFrame, expected: DataFrame | None = None, sides=scores.TRAIN_SIDES) -> None:
    """Integrity checks that can fail: shared vocabulary, shared split, recorded values."""
    def cells(name):
        return results.select("seed", "cell", F.col(name).alias("value"))

    scores.require_shared_vocabulary(cells("vocab_size"), sides)
    scores.require_shared_split(cells("test_idx_sha1"))
    if expected is not None:
        scores.require_expected(cells("macro_f1"), expected, 1e-9)


def summary(results: DataFrame, contrasts=scores.CONTRASTS) -> DataFrame:
    """Paired deltas of a run."""
    return scores.paired_deltas(results.select("seed", "cell", F.col("macro_f1").alias("value")), contrasts)


def token_ablation(df: DataFrame, token: str, labels: list, seeds=sampling.SEEDS, n: int = sampling.N_SAMPLE, kind: str = "logistic",
                   dirty: str = "text", repaired: str = "repaired", prepare: Prepare = None) -> DataFrame:
    """One entity's number as a token: what its weight does, apart from the rest of the repair.

    All cells use the model of the dirty side. A: dirty test, Z: dirty test with the
    token silenced, P: only this entity repaired, B: all repaired. A-Z and Z-B add up
    to A-B.
    """
    def partly(rows: DataFrame) -> DataFrame:
        return (prepare(rows) if prepare else rows).withColumn("_partly", repair_number(F.col(dirty), int(token)))

    done = run(df, [Cell("A", dirty, dirty), Cell("P", dirty, "_partly"), Cell("B", dirty, repaired)], labels, "ablation", seeds, n, kind, prepare=partly)
    rows = df.select(F.col("doc_id").alias("id"), "label")
    asks = [("Z", m, dirty) for m in range(len(done.models.fits))]
    silenced = models.predict(done.models.silenced(token), done.tokens, rows, asks, done.train)
    found = scores.macro_f1(silenced, ["cell", "seed"]).select("seed", "cell", F.col("macro_f1").alias("value"))
    return done.results.select("seed", "cell", F.col("macro_f1").alias("value")).unionByName(found)


def learning_curve(df: DataFrame, labels: list, ladder=None, anchors=(100, 200), anchor_rows: int = 24_000, seeds=range(10),
                   text: str = "repaired", kind: str = "bayes", row_id: str = "doc_id") -> DataFrame:
    """Scores on fixed test anchors for nested training prefixes of one shuffle per seed.

    Counts of all steps, seeds and anchors come from one aggregation, their scores from one join. Without
    ``ladder`` its steps keep the published ladder's proportions of the pool.
    """
    ids = settle(df.select(row_id, "label"))
    held = settle(reduce(DataFrame.unionByName, [sampling.sample_n(ids, anchor_rows, a, row_id).withColumn("anchor", F.lit(a)) for a in anchors]))
    pool = settle(ids.join(held.select(row_id), row_id, "left_anti"))
    if ladder is None:
        size = pool.count()
        ladder = [size * step // sampling.LADDER_POOL for step in sampling.LADDER]
    steps = sampling.nested_prefixes(pool, ladder, seeds, row_id).filter("step is not null")
    train = settle(steps.select(F.col(row_id).alias("id"), "seed", "step", "label"))
    tokens = models.long_tokens(df.select(row_id, text), [text], row_id)
    fitted = models.fit(tokens, train, [models.Fit(text, seed, step, kind) for seed in seeds for step in ladder], labels)
    rows = held.select(F.col(row_id).alias("id"), "label", "anchor")
    # A row may be in several anchors, so anchors are joined to predictions and not asked about.
    asked = models.predict(fitted, tokens.join(rows.select("id").distinct(), "id", "left_semi"), rows.select("id", "label").distinct(),
                           [("x", m, text) for m in range(len(fitted.fits))])
    found = scores.macro_f1(asked.join(rows.select("id", "anchor"), "id"), ["anchor", "seed", "step"])
    sizes = fitted.vocabulary_sizes()
    listed = [(one.seed, one.step, sizes.get(m, 0)) for m, one in enumerate(fitted.fits)]
    about = df.sparkSession.createDataFrame(listed, "seed INT, step INT, vocab_size INT")
    return found.join(about, ["seed", "step"]).select("anchor", "seed", "step", "macro_f1", "vocab_size")


def top_tokens(fitted: models.Models, k: int = TOP_TOKENS) -> DataFrame:
    """The k heaviest tokens of each class of each model, by their weights on scaled features."""
    labels = F.array(*[F.lit(x) for x in fitted.labels])
    long = fitted.terms.select("model", "term", "scale", F.posexplode("weights").alias("c", "weight")).withColumn("weight", F.col("weight") / F.col("scale"))
    rank = F.row_number().over(Window.partitionBy("model", "c").orderBy(F.desc("weight"), "term"))
    best = long.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("model", F.element_at(labels, F.col("c") + 1).alias("label"), "rank", "term", "weight")


def with_confidence(predictions: DataFrame) -> DataFrame:
    """Add the probability of the predicted class."""
    return predictions.withColumn("confidence", F.array_max(models.probabilities(F.col("margins")))).drop("margins")


def confident_errors(predictions: DataFrame, k: int = CONFIDENT_ERRORS) -> DataFrame:
    """The k wrong rows the model was surest of."""
    wrong = with_confidence(predictions).filter(F.col("prediction") != F.col("label"))
    return wrong.orderBy(F.desc("confidence"), "id").limit(k)


def batch_score(fitted: models.Models, model: int, rows: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Class, confidence, share of unknown tokens and length flags.

    Short rows are answered with a flag; only empty or oversized ones get no class. Unknown tokens are
    those the model has no weight for.
    """
    tokens = models.long_tokens(rows, [text], row_id)
    scored = models.predict(fitted, tokens, rows.select(F.col(row_id).alias("id")), [("x", model, text)])
    answers = with_confidence(scored).select(F.col("id").alias(row_id), "prediction", "confidence")
    known = fitted.terms.filter(F.col("model") == model).select("term")
    flags = vocabulary.out_of_vocabulary(rows, known, text, row_id)
    return flags.join(answers, row_id).withColumns({
        name: F.when(~F.col("rejected"), F.col(name)) for name in ("prediction", "confidence")
    })


def held_out_numbers(fitted: models.Models, rows: DataFrame, variants: list[tuple[str, int]], row_id: str = "doc_id") -> DataFrame:
    """Macro F1 of (variant, model) pairs on held-out rows that no fit has seen: cell (the variant), macro_f1."""
    tokens = models.long_tokens(rows, [variant for variant, _ in variants], row_id)
    asks = [(variant, model, variant) for variant, model in variants]
    found = models.predict(fitted, tokens, rows.select(F.col(row_id).alias("id"), "label"), asks)
    return scores.macro_f1(found, ["cell"])
