"""Linear text models on long tables: naive Bayes, logistic regression and linear SVC.

Tokens are one row per (row, text variant, term); a model is one row per term with a weight per class.
Vocabularies, features and scores never pass through the driver: fitting counts is an aggregation,
scoring is a join on the term and a sum, and all models of an experiment go through both at once.

Logistic regression and SVC are Spark ML's own. Their penalty is blind to rotations of the feature space,
and a training sample of n rows spans n dimensions at most. So the sample's inner products are factored
and turned into n coordinates of about equal variance, on which Spark's solver, which rescales columns,
converges in a few dozen steps; on sparse text columns it has not after a thousand. The fitted vector goes back to
terms as a weighted sum of the training rows. Inner products are worked out in tiles; one task factors them and holds
the square of the sample, which ``ROW_LIMIT`` bounds. The driver holds a few numbers per row of the sample.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.text import tokens as tokens_in
from textassay.operators.keyed import join_by_frequency
from textassay.operators.vocabulary import smooth_idf, word_pairs
from textassay.session import LARGE_ROWS, broadcast_checked, discard, settle

# The classifier's defaults.
PENALTY_C = 1.0
MAX_ITER = 1000
# Relative change of the objective at which Spark's solver stops.
TOLERANCE = 1e-9
# No entry of the gradient may be larger at the end.
GRADIENT = 1e-4
# Rows of a training sample whose inner products one task may hold.
ROW_LIMIT = 5_000
# Rows and terms of a tile of the inner products, rows of a batch.
TILE_ROWS = 1_000
TILE_TERMS = 4_096
BATCH_ROWS = 250
# Added to the diagonal of the inner products, so that equal rows can be factored.
RIDGE = 1e-10
PAIRS = "~2"
# Models whose sums are worked out side by side, and weights of terms that may be broadcast for them.
PLACES = 16
LEAST_PLACES = 4
WIDE_VALUES = 10_000_000


@dataclass(frozen=True)
class Fit:
    """One model: the rows and text variant it is fit on, and its settings. Rows up to ``step`` are used."""

    variant: str
    seed: int
    step: int = 0
    kind: str = "bayes"
    min_df: int = 1
    max_features: int | None = None
    c: float = PENALTY_C
    max_iter: int = MAX_ITER


@dataclass
class Models:
    """Fitted models: ``terms`` is ``model, term, scale, weights``; a model is its place in ``fits``."""

    fits: list[Fit]
    labels: list
    terms: DataFrame
    intercepts: list[list[float]]

    def vocabulary_sizes(self) -> dict[int, int]:
        """Terms of every model."""
        return {row.model: row.n for row in self.terms.groupBy("model").agg(F.count("*").alias("n")).collect()}

    def silenced(self, token: str) -> Models:
        """The same models with one token's weights at zero; it keeps its share of the norm."""
        zero = F.transform("weights", lambda x: F.lit(0.0))
        terms = self.terms.withColumn("weights", F.when(F.col("term") == token, zero).otherwise(F.col("weights")))
        return Models(self.fits, self.labels, terms, self.intercepts)

    def save(self, path: str) -> None:
        """Write the models to a new folder."""
        spark = self.terms.sparkSession
        self.terms.write.parquet(f"{path}/terms")
        rows = [(k, json.dumps(asdict(fit)), json.dumps(self.labels), json.dumps(b)) for k, (fit, b) in enumerate(zip(self.fits, self.intercepts))]
        spark.createDataFrame(rows, "model int, fit string, labels string, intercepts string").coalesce(1).write.json(f"{path}/fits")


def load(spark: SparkSession, path: str) -> Models:
    """Models as they were saved."""
    rows = sorted(spark.read.schema("model int, fit string, labels string, intercepts string").json(f"{path}/fits").collect())
    return Models([Fit(**json.loads(r.fit)) for r in rows], json.loads(rows[0].labels), spark.read.parquet(f"{path}/terms"),
                  [json.loads(r.intercepts) for r in rows])


def long_tokens(df: DataFrame, variants: list[str], row_id: str = "doc_id") -> DataFrame:
    """Settled ``id, variant, term, tf``. A variant is a text column; with ``~2`` behind it word pairs count too."""
    def terms(name):
        words = tokens_in(F.col(name.removesuffix(PAIRS)))
        return F.concat(words, word_pairs(words)) if name.endswith(PAIRS) else words

    def task(batches):
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                for name, column in zip(variants, part.columns[1:]):
                    coded = column.flatten().dictionary_encode()
                    n = max(1, len(coded.dictionary))
                    keys, tf = np.unique(pc.list_parent_indices(column).to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(keys // n)), pa.repeat(name, len(keys)), coded.dictionary.take(pa.array(keys % n)), pa.array(tf.astype(np.int32)),
                    ], ["id", "variant", "term", "tf"])

    # All variants of a row come from one pass over the texts; a row's terms are counted in its batch, so nothing is shuffled.
    listed = df.select(F.col(row_id).alias("id"), *(terms(name).alias(f"w{i}") for i, name in enumerate(variants)))
    kind = listed.schema["id"].dataType.simpleString()
    return settle(listed.mapInArrow(task, f"id {kind}, variant string, term string, tf int"))


def targets(label: Column, labels: list) -> Column:
    """Dense class index 0..k-1."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1


def fit(tokens: DataFrame, train: DataFrame, fits: list[Fit], labels: list) -> Models:
    """Fit all models. ``train`` is ``id, seed, step, label``, settled, one row per training row and seed."""
    train = train.select("id", "seed", "step", targets(F.col("label"), labels).cast("int").alias("target"))
    terms, intercepts = [], {}
    counting = {k: one for k, one in enumerate(fits) if one.kind == "bayes"}
    if counting:
        found, own = _fit_bayes(tokens, train, counting, len(labels))
        terms.append(found)
        intercepts |= own
    alike: dict[tuple, dict[int, Fit]] = {}
    for k, one in enumerate(fits):
        if one.kind != "bayes":
            alike.setdefault((one.variant, one.seed, one.step, one.min_df, one.max_features), {})[k] = one
    for together in alike.values():
        for k, (found, own) in _fit_linear(tokens, train, together, len(labels)).items():
            intercepts[k] = own
            terms.append(found.select(F.lit(k).alias("model"), "term", "scale", "weights"))
    return Models(list(fits), list(labels), reduce(DataFrame.unionByName, terms), [intercepts[k] for k in range(len(fits))])


def _chosen(counts: DataFrame, one: Fit) -> DataFrame:
    """Terms within a model's settings; ``counts`` has ``term, df, total``."""
    kept = counts.filter(F.col("df") >= one.min_df)
    return kept.orderBy(F.desc("total"), "term").limit(one.max_features) if one.max_features else kept


def _fit_bayes(tokens: DataFrame, train: DataFrame, fits: dict[int, Fit], k: int) -> tuple[DataFrame, dict[int, list[float]]]:
    """Multinomial with add-one smoothing. One aggregation counts for all models; prefixes add up inside it."""
    spark = tokens.sparkSession
    steps = sorted({one.step for one in fits.values()})
    wanted = tokens.filter(F.col("variant").isin(sorted({one.variant for one in fits.values()})))
    joined = wanted.join(broadcast_checked(train), "id")
    within = [F.col("step") <= s for s in steps]
    sums = [F.sum(F.when(w & (F.col("target") == c), F.col("tf")).otherwise(0)).alias(f"n{i}_{c}") for i, w in enumerate(within) for c in range(k)]
    per_term = joined.groupBy("variant", "seed", "term").agg(*sums, *(F.count_if(w).alias(f"df{i}") for i, w in enumerate(within)))
    listed = per_term.select("variant", "seed", "term", F.inline(F.array(*(
        F.struct(F.lit(s).alias("step"), F.col(f"df{i}").alias("df"), F.array(*(F.col(f"n{i}_{c}") for c in range(k))).alias("counts"))
        for i, s in enumerate(steps)
    )))).filter("df > 0")
    listed = listed.withColumn("total", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))
    if any(one.max_features for one in fits.values()):
        listed = settle(listed)
    plain = [(m, one.variant, one.seed, one.step, one.min_df) for m, one in fits.items() if not one.max_features]
    parts = [
        _chosen(listed.filter((F.col("variant") == one.variant) & (F.col("seed") == one.seed) & (F.col("step") == one.step)), one)
        .select(F.lit(m).alias("model"), "term", "counts") for m, one in fits.items() if one.max_features
    ]
    if plain:
        # One row per model.
        asked = F.broadcast(spark.createDataFrame(plain, "model int, variant string, seed int, step int, min_df int"))
        parts.append(listed.join(asked, ["variant", "seed", "step"]).filter("df >= min_df").select("model", "term", "counts"))
    counted_terms = settle(reduce(DataFrame.unionByName, parts))
    mass = {row[0]: row[1:] for row in counted_terms.groupBy("model").agg(
        F.count("*"), *(F.sum(F.col("counts")[c]) for c in range(k))
    ).collect()}
    rows = [row[:] for row in train.groupBy("seed", "step", "target").agg(F.count("*")).collect()]
    bases, intercepts = [], {}
    for m, one in fits.items():
        width, *total = mass.get(m, (0, *[0] * k))
        n = [sum(count for seed, step, target, count in rows if (seed, target) == (one.seed, c) and step <= one.step) for c in range(k)]
        # A class without training rows is never predicted.
        intercepts[m] = [float(np.log(x + 1.0)) if x else float("-inf") for x in n]
        bases.append((m, [float(np.log(t + width)) if t + width else 0.0 for t in total]))
    based = counted_terms.join(F.broadcast(spark.createDataFrame(bases, "model int, bases array<double>")), "model")
    weights = F.zip_with("counts", "bases", lambda n, base: F.log(n + 1.0) - base)
    return based.select("model", "term", F.lit(1.0).alias("scale"), weights.alias("weights")), intercepts


def _fit_linear(tokens: DataFrame, train: DataFrame, fits: dict[int, Fit], k: int) -> dict[int, tuple[DataFrame, list[float]]]:
    """TF-IDF rows of unit length, Spark's classifiers in rotated coordinates, and the weights of the terms.

    All of ``fits`` have the same rows and terms, so the coordinates are worked out once.
    """
    classifiers = {"logistic": _logistic, "svc": _svc}
    for one in fits.values():
        if one.kind not in classifiers:
            raise ValueError(f"unknown classifier {one.kind!r}")
    one = next(iter(fits.values()))
    own = train.filter((F.col("seed") == one.seed) & (F.col("step") <= one.step)).select("id", "target")
    listed = sorted(own.limit(ROW_LIMIT + 1).collect())
    n = len(listed)
    if n > ROW_LIMIT:
        raise ValueError(f"a training sample may have {ROW_LIMIT} rows; draw fewer")
    numbered = F.broadcast(own.sparkSession.createDataFrame([(row.id, i) for i, row in enumerate(listed)], "id bigint, row int"))
    # Rows that repeat an id hold the words of both, as they do in scoring.
    counts = settle(tokens.filter(F.col("variant") == one.variant).join(numbered, "id").groupBy("row", "term").agg(F.sum("tf").alias("tf")))
    frequencies = _chosen(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), one)
    scaled = counts.join(frequencies.select("term", smooth_idf(F.lit(n), F.col("df")).alias("scale")), "term")
    weighted = settle(scaled.withColumn("w", F.col("tf") * F.col("scale")))
    norms = weighted.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x = settle(weighted.join(F.broadcast(norms), "row").select("row", "term", "scale", (F.col("w") / F.col("norm")).alias("w")))
    discard(counts, weighted)
    target = np.array([row.target for row in listed])
    products = settle(_inner_products(x, n), LARGE_ROWS)
    rotated = settle(_coordinates(products, target), LARGE_ROWS)  # solvers read it in parallel, a row group at a time, and hold it themselves
    discard(products)
    found = {}
    for m, one in fits.items():
        inner, intercepts = classifiers[one.kind](rotated.select("target", array_to_vector("x").alias("features")), one, n, k)
        if one.kind == "logistic":
            _require_optimum(rotated, inner, intercepts, one, n)
        shares = _shares(rotated, inner, n)
        listed_shares = x.sparkSession.createDataFrame(pa.table({
            "row": pa.array(np.arange(n, dtype=np.int32)), "share": pa.array(list(shares), pa.list_(pa.float64())),
        }))
        sums = [F.sum(F.col("w") * F.col("share")[c]) for c in range(k)]
        # At most ROW_LIMIT rows.
        terms = x.join(F.broadcast(listed_shares), "row").groupBy("term").agg(F.first("scale").alias("scale"), F.array(*sums).alias("sums"))
        # A document's term counts for tf times scale, over the norm.
        weights = F.transform("sums", lambda value: value * F.col("scale"))
        found[m] = settle(terms.select("term", "scale", weights.alias("weights"))), intercepts
    discard(x, rotated)
    return found


def _inner_products(x: DataFrame, n: int, tile: int = TILE_ROWS) -> DataFrame:
    """Inner products of all training rows, on and below the diagonal: ``row``, ``start`` (a row) and the products from there on."""
    own, last = F.floor(F.col("row") / tile).cast("int"), max(0, n - 1) // tile
    sent = x.select("row", "term", "w", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("other"))
    sent = sent.select("row", "term", "w", F.greatest(own, "other").alias("upper"), F.least(own, "other").alias("lower"))

    def products(key, table):
        """Rows of one stretch times rows of another, for so many terms at a time."""
        left, right = (value.as_py() * tile for value in key)
        row, w = table["row"].to_numpy(), table["w"].to_numpy()
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((row, term // TILE_TERMS))
        row, w, term = row[order], w[order], term[order]
        out = np.zeros((min(tile, n - left), min(tile, n - right)))
        ends = np.searchsorted(term // TILE_TERMS, np.arange(term.max() // TILE_TERMS + 2))
        for start, end in zip(ends, ends[1:]):
            r, t, v = row[start:end], term[start:end] % TILE_TERMS, w[start:end]
            columns = np.zeros((TILE_TERMS, out.shape[1]))
            inside = (r >= right) & (r < right + tile)
            columns[t[inside], r[inside] - right] = v[inside]
            inside = (r >= left) & (r < left + tile)
            r, t, v = r[inside] - left, t[inside], v[inside]
            edges = np.searchsorted(r, np.arange(len(out) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                held = slice(edges[k], edges[k + 1])
                out[k] += v[held] @ columns[t[held]]
        return pa.table({
            "row": pa.array(np.arange(left, left + len(out), dtype=np.int32)), "start": pa.array(np.full(len(out), right, np.int32)),
            "products": pa.array([line.tobytes() for line in out], pa.binary()),
        })

    return sent.groupBy("upper", "lower").applyInArrow(products, "row int, start int, products binary")


def _coordinates(products: DataFrame, target: np.ndarray) -> DataFrame:
    """Rows of the triangular factor of the inner products, turned so that all columns vary about alike: ``row, target, x``."""
    n, width = len(target), _width(len(target))

    def task(batches):
        inner = np.zeros((n, n))
        for batch in batches:
            for row, start, line in zip(*(column.to_pylist() for column in batch.columns)):
                line = np.frombuffer(line)
                inner[row, start : start + len(line)] = line
        inner[np.diag_indices(n)] += RIDGE
        factor = np.linalg.cholesky(inner)  # reads what is on and below the diagonal
        del inner
        for start in range(0, n, BATCH_ROWS):
            rows = factor[start : start + BATCH_ROWS]
            padded = np.zeros((len(rows), width))
            padded[:, :n] = rows * _signs(width)[:n]
            places = np.arange(start, start + len(rows), dtype=np.int32)
            x = pa.FixedSizeListArray.from_arrays(pa.array(_hadamard(padded).ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(target[places].astype(np.float64)), x], ["row", "target", "x"])

    return products.coalesce(1).mapInArrow(task, "row int, target double, x array<double>")


def _width(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(0).choice([-1.0, 1.0], width)


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """Every row times the normalised Hadamard matrix, which is its own inverse; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        halves = rows.reshape(n, -1, 2, step)
        rows = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def _rotated_back(rows: np.ndarray, n: int) -> np.ndarray:
    """Rotated rows in the coordinates of the factor."""
    return (_hadamard(rows) * _signs(rows.shape[1]))[:, :n]


def _shares(rotated: DataFrame, inner: np.ndarray, n: int) -> np.ndarray:
    """Share of every training row in the fitted vector of every class (n x classes)."""
    own = _rotated_back(inner, n).T

    def task(batches):
        factor = np.zeros((n, n))
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                factor[part.column(0).to_numpy()] = _rotated_back(_matrix(part.column(1)), n)
        left = own.copy()  # back substitution, a block of rows at a time
        for start in reversed(range(0, n, BATCH_ROWS)):
            block = slice(start, start + BATCH_ROWS)
            left[block] = np.linalg.solve(np.tril(factor[block, block]).T, left[block])
            left[:start] -= factor[block, :start].T @ left[block]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(left), pa.list_(pa.float64()))], ["row", "share"])

    found = rotated.select("row", "x").coalesce(1).mapInArrow(task, "row int, share array<double>").collect()
    return np.array([row.share for row in sorted(found)])


def _converged(iterations: int, one: Fit) -> None:
    if iterations >= one.max_iter:
        raise RuntimeError(f"the fit has not converged within {one.max_iter} steps")


def _require_optimum(rotated: DataFrame, inner: np.ndarray, intercepts: list[float], one: Fit, n: int) -> None:
    """The gradient of the loss vanishes at the fitted weights; solvers may stop before it does."""
    def task(batches):
        for batch in batches:
            target, rows = batch.column(0).to_numpy().astype(int), _matrix(batch.column(1))
            margins = rows @ inner.T + np.array(intercepts)
            error = np.exp(margins - margins.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(target)), target] -= 1
            yield pa.RecordBatch.from_arrays([pa.array(list(error.T @ rows) + [error.sum(axis=0)], pa.list_(pa.float64())), pa.array(range(len(inner) + 1))], ["sums", "c"])

    sums = {}
    for row in rotated.select("target", "x").mapInArrow(task, "sums array<double>, c long").toLocalIterator():
        sums[row.c] = sums.get(row.c, 0.0) + np.array(row.sums)
    free = slice(1, None) if len(inner) == 2 else slice(None)
    slope = (np.array([sums[c] for c in range(len(inner))]) + inner / one.c)[free] / n
    most = max(np.abs(slope).max(), np.abs(sums[len(inner)][free] / n).max())
    if most > GRADIENT:
        raise RuntimeError(f"the fit stopped at a gradient of {most:.1e}")


def _logistic(rows: DataFrame, one: Fit, n: int, k: int) -> tuple[np.ndarray, list[float]]:
    """Mean log loss plus ``|w|^2 / (2 c n)``, intercepts free; two classes share one vector."""
    model = LogisticRegression(labelCol="target", standardization=False, regParam=1.0 / (one.c * n), maxIter=one.max_iter, tol=TOLERANCE).fit(rows)
    _converged(model.summary.totalIterations, one)
    inner, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(inner) < k:
        return np.concatenate([np.zeros_like(inner), inner]), [0.0, float(intercepts[0])]
    return inner, intercepts.tolist()


def _svc(rows: DataFrame, one: Fit, n: int, k: int) -> tuple[np.ndarray, list[float]]:
    """Hinge loss, one class against the rest; the largest margin wins. Two classes need one fit."""
    inner, intercepts = [], []
    for c in range(1 if k == 2 else 0, k):
        own = rows.select("features", (F.col("target") == c).cast("double").alias("own"))
        model = LinearSVC(labelCol="own", standardization=False, regParam=1.0 / (one.c * n), maxIter=one.max_iter).fit(own)
        _converged(model.summary().totalIterations, one)
        inner.append(model.coefficients.toArray())
        intercepts.append(float(model.intercept))
    if k == 2:
        return np.array([-inner[0], inner[0]]), [-intercepts[0], intercepts[0]]
    return np.array(inner), intercepts


def predict(models: Models, tokens: DataFrame, rows: DataFrame, asks: list[tuple[str, int, str]], train: DataFrame | None = None) -> DataFrame:
    """Predictions of every asked (cell, model, variant) for every row of ``rows`` (``id`` and more).

    With ``train`` (``id, seed``) a model is not asked about rows of its own training side. Adds
    ``cell, seed, step, prediction, margins``; equal margins go to the earlier label. A row without a known
    term is decided by the intercepts.
    """
    k = len(models.labels)
    own = models.terms.filter(F.col("model").isin(sorted({m for _, m, _ in asks})))
    fitting = WIDE_VALUES // max(1, own.select("term").distinct().count()) // (k + 1)
    # So many models that their weights can be broadcast; as many as go side by side if that would be few.
    width = PLACES if fitting < LEAST_PLACES else min(PLACES, fitting)
    places, parts = {}, {}
    for cell, m, variant in asks:
        held = places.setdefault(variant, {})
        place = held.setdefault(m, len(held))
        parts.setdefault(place // width, []).append((cell, m, variant, place))
    # Variants that are asked the same of the same models share one table of weights.
    alike = {variant: min(v for v in places if places[v] == held) for variant, held in places.items()}
    known = broadcast_checked(settle(train.select("id", "seed").distinct())) if train is not None else None
    found = [_predict(models, tokens, rows, part, alike, known) for part in parts.values()]
    # One after another, so that the driver holds one table of weights at a time.
    return reduce(DataFrame.unionByName, found if len(found) == 1 else map(settle, found))


def _predict(models: Models, tokens: DataFrame, rows: DataFrame, asks: list[tuple[str, int, str, int]], alike: dict[str, str],
             train: DataFrame | None) -> DataFrame:
    """Predictions of some models. All models asked about a variant have a place there; a term brings all their weights at once."""
    spark = tokens.sparkSession
    k = len(models.labels)
    listed = [
        (cell, variant, place, models.fits[m].seed, models.fits[m].step, models.intercepts[m], models.fits[m].kind != "bayes")
        for cell, m, variant, place in asks
    ]
    # One row per asked cell and model.
    asked = spark.createDataFrame(listed, "cell string, variant string, place int, seed int, step int, intercepts array<double>, unit boolean")
    placed = spark.createDataFrame(sorted({(m, alike[variant], place) for _, m, variant, place in asks}), "model int, table string, place int")
    variants = spark.createDataFrame(sorted({(variant,) for _, _, variant, _ in asks}), "variant string")
    used = tokens.join(F.broadcast(spark.createDataFrame(sorted({(variant, alike[variant]) for _, _, variant, _ in asks}), "variant string, table string")), "variant")
    places = sorted({place for *_, place in asks})
    units = sorted({place for _, m, _, place in asks if models.fits[m].kind != "bayes"})
    at = lambda place, value: F.max(F.when(F.col("place") == place, value))
    wide = settle(models.terms.join(F.broadcast(placed), "model").groupBy("table", "term").agg(
        *(at(p, F.col("weights")[c]).alias(f"w{p}_{c}") for p in places for c in range(k)), *(at(p, F.col("scale")).alias(f"scale{p}") for p in units)
    ))
    met = _met(used, wide, WIDE_VALUES // (len(places) * k + len(units)))
    sums = met.groupBy("id", "variant").agg(
        *(F.sum(F.col("tf") * F.col(f"w{p}_{c}")).alias(f"s{p}_{c}") for p in places for c in range(k)),
        *(F.sum(F.pow(F.col("tf") * F.col(f"scale{p}"), 2)).alias(f"square{p}") for p in units),
    )
    held = F.array(*(F.struct(
        F.lit(p).alias("place"), F.array(*(F.col(f"s{p}_{c}") for c in range(k))).alias("sums"),
        (F.col(f"square{p}") if p in units else F.lit(None).cast("double")).alias("square"),
    ) for p in places))
    every = rows.join(F.broadcast(variants)).join(sums, ["id", "variant"], "left").select(*rows.columns, "variant", F.inline(held))
    every = every.join(F.broadcast(asked), ["variant", "place"])
    if train is not None:
        every = every.join(train, ["id", "seed"], "left_anti")
    norm = F.when(F.col("unit") & (F.col("square") > 0), F.sqrt("square")).otherwise(F.lit(1.0))
    margins = F.array(*(F.coalesce(F.col("sums")[c] / norm, F.lit(0.0)) + F.col("intercepts")[c] for c in range(k)))
    scored = every.withColumn("margins", margins)
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in models.labels]), best)
    return scored.select(*rows.columns, "cell", "seed", "step", label.alias("prediction"), "margins")


def _met(tokens: DataFrame, wide: DataFrame, limit: int) -> DataFrame:
    """Tokens with the weights of their terms. Up to ``limit`` terms are broadcast, and tokens stay with their row; others are shuffled."""
    if wide.limit(limit + 1).count() <= limit:
        return tokens.join(F.broadcast(wide), ["table", "term"])
    frequencies = tokens.groupBy("table", "term").agg(F.count("*").alias("n"))
    key = F.struct("table", "term").alias("key")
    keyed = settle(wide.join(frequencies, ["table", "term"]).withColumn("key", key).drop("table", "term"))
    return join_by_frequency(tokens.select("id", "variant", "tf", key), keyed, "key", "n", "id")


def probabilities(margins: Column) -> Column:
    """Softmax of the margins."""
    grown = F.transform(margins, lambda x: F.exp(x - F.array_max(margins)))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda a, y: a + y))
