"""Weights, fits, scores and experiments against plain arithmetic."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textassay.operators import sampling, scores, vocabulary
from textassay.plans import experiment, inputs, models, queries
from textassay.sources import corpus

TEXTS = [
    (1, "The cat sat on the mat, the cat!"), (1, "A cat and a dog"), (1, "cat cat mat"),
    (2, "stocks fell on Monday"), (2, "the stocks rose; markets rose"), (2, "markets and stocks"),
    (3, "Chávez résumé naïve"), (3, "the résumé of Chávez"), (3, "naïve the 39"),
]
LABELS = [1, 2, 3]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, label, text) for i, (label, text) in enumerate(TEXTS * 4)]
    return spark.createDataFrame(data, "doc_id BIGINT, label INT, text STRING").repartition(3)


@pytest.fixture(scope="module")
def wide(spark):
    """400 rows of 60 rare and common words over more than 20,000 columns."""
    pick = np.random.default_rng(1)
    data = []
    for i in range(400):
        label = i % 3 + 1
        words = [f"own{i}x{k}" for k in range(55)] + [f"c{label}w{k}" for k in pick.integers(0, 40, 6)] + ["the"] * int(pick.integers(1, 9))
        data.append((i, label, " ".join(words)))
    return spark.createDataFrame(data, "doc_id BIGINT, label INT, text STRING")


def words(text):
    return re.findall(r"\b\w\w+\b", text.lower())


def unit_rows(texts):
    """TF-IDF rows of unit length."""
    docs = [Counter(words(text)) for text in texts]
    df = Counter(t for d in docs for t in d)
    out = []
    for d in docs:
        w = {t: tf * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, tf in d.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def trained(df, fits, labels=LABELS, steps=None):
    tokens = models.long_tokens(df, sorted({one.variant for one in fits}))
    train = df.select(F.col("doc_id").alias("id"), F.lit(0).alias("seed"), (steps if steps is not None else F.lit(0)).alias("step"), "label")
    return models.fit(tokens, train, fits, labels), tokens


def term_weights(found, model=0):
    """Weights on unit-length rows: what the scale of a term adds is taken out again."""
    return {r.term: np.array(r.weights) / r.scale for r in found.terms.filter(F.col("model") == model).collect()}


def predicted(found, tokens, df, variant="text", model=0):
    out = models.predict(found, tokens, df.select(F.col("doc_id").alias("id"), "label"), [("x", model, variant)])
    return {r.id: r for r in out.collect()}


def test_long_weights_equal_the_formula(rows):
    found = {(r.doc_id, r.term): r.weight for r in vocabulary.tfidf(rows).collect()}
    want = unit_rows([text for _, text in TEXTS * 4])
    assert found == pytest.approx({(i, t): x for i, w in enumerate(want) for t, x in w.items()})


def gradient(found, df, labels):
    """Largest entry of the gradient of mean loss plus half the squared norm over n (C = 1), over all terms."""
    data = sorted((r.doc_id, r.label, r.text) for r in df.collect())
    x, w, b = unit_rows([text for *_, text in data]), term_weights(found), np.array(found.intercepts[0])
    free = 1 if len(labels) == 2 else 0
    slope, slope_b = {t: v.copy() for t, v in w.items()}, np.zeros(len(labels))
    for row, (_, label, _) in zip(x, data):
        z = sum(v * w[t] for t, v in row.items()) + b
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels.index(label)] -= 1
        for t, v in row.items():
            slope[t] += v * p
        slope_b += p
    return max(max(np.abs(v[free:]).max() for v in slope.values()), np.abs(slope_b[free:]).max()) / len(data)


@pytest.mark.parametrize("labels", [[1, 2, 3], [1, 2]])
def test_logistic_reaches_the_optimum_of_its_objective(rows, labels):
    df = rows.filter(F.col("label").isin(labels))
    found, tokens = trained(df, [models.Fit("text", 0, kind="logistic")], labels)
    assert gradient(found, df, labels) < 1e-5
    assert all(r.prediction == r.label for r in predicted(found, tokens, df).values())
    top = experiment.top_tokens(found, 2).filter("label = 2 and rank = 1").first()
    assert top.term == "stocks"


def test_wide_fit_reaches_the_optimum_for_any_partitioning(wide):
    found = [trained(wide.repartition(k, "doc_id"), [models.Fit("text", 0, kind="logistic")])[0] for k in (1, 8)]
    assert found[0].vocabulary_sizes()[0] > 20_000
    assert gradient(found[0], wide, LABELS) < 1e-5
    one, other = map(term_weights, found)
    assert max(np.abs(one[t] - other[t]).max() for t in one) < 1e-3


def test_fit_keeps_the_square_of_the_sample_off_the_driver(spark):
    n = 1200
    data = [(i, i % 2 + 1, f"own{i} pair{i // 2} mod{i % 7} rest{i % 11} side{i % 2 if i % 5 else 0}") for i in range(n)]
    df = spark.createDataFrame(data, "doc_id BIGINT, label INT, text STRING")
    tracemalloc.start()
    try:
        found, _ = trained(df, [models.Fit("text", 0, kind="logistic")], [1, 2])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * n * n
    assert gradient(found, df, [1, 2]) < 1e-5


def test_inner_products_of_tiles(spark):
    pick = np.random.default_rng(2)
    x = np.where(pick.random((23, 40)) < 0.2, pick.random((23, 40)), 0.0)
    x[5] = 0  # a row without terms
    entries = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*x.nonzero())], "row INT, term STRING, w DOUBLE")
    for tile in (1, 7, 100):
        got = np.zeros((23, 23))
        for r in models._inner_products(entries, 23, tile).collect():
            line = np.frombuffer(r.products)
            got[r.row, r.start : r.start + len(line)] = line
        assert np.allclose(np.tril(got), np.tril(x @ x.T))


def test_svc_reaches_the_minimum_of_its_objective(wide):
    """No small step lowers mean hinge loss plus half the squared norm over n, beyond the solver's tolerance."""
    df = wide.filter("label < 3")
    found, tokens = trained(df, [models.Fit("text", 0, kind="svc")], [1, 2])
    data = sorted((r.doc_id, r.label, r.text) for r in df.collect())
    x, w, b = unit_rows([t for *_, t in data]), {t: v[1] for t, v in term_weights(found).items()}, found.intercepts[0][1]
    sign = [1 if label == 2 else -1 for _, label, _ in data]
    n = len(data)

    def objective(scale, shift):
        loss = sum(max(0, 1 - s * (scale * sum(v * w[t] for t, v in r.items()) + b + shift)) for r, s in zip(x, sign)) / n
        return loss + sum(v * v for v in w.values()) * scale * scale / 2 / n

    best = objective(1, 0)
    assert all(objective(1 + d, e) > best - 1e-3 for d in (-0.2, 0, 0.2) for e in (-0.1, 0, 0.1))
    assert all(r.prediction == r.label for r in predicted(found, tokens, df).values())


def test_linear_fits_of_the_same_rows_share_their_coordinates(rows, monkeypatch):
    """Kinds and penalties differ after the coordinates; each model is what a fit of its own gives."""
    made = []
    coordinates = models._coordinates
    monkeypatch.setattr(models, "_coordinates", lambda *args: made.append(1) or coordinates(*args))
    fits = [models.Fit("text", 0, kind="svc"), models.Fit("text", 0, kind="logistic"), models.Fit("text", 0, kind="logistic", c=5.0),
            models.Fit("text", 0, kind="logistic", min_df=2)]
    together, _ = trained(rows, fits)
    assert len(made) == 2
    for m, one in enumerate(fits[:3]):
        alone, _ = trained(rows, [one])
        ours, theirs = term_weights(together, m), term_weights(alone)
        assert ours.keys() == theirs.keys() and all(ours[t] == pytest.approx(theirs[t], abs=1e-6) for t in ours)
        assert together.intercepts[m] == pytest.approx(alone.intercepts[0], abs=1e-6)


def test_a_fit_that_does_not_converge_is_an_error(wide):
    for kind in ("logistic", "svc"):
        with pytest.raises(RuntimeError, match="within 2 steps"):
            trained(wide, [models.Fit("text", 0, kind=kind, max_iter=2)])


def test_a_sample_beyond_the_limit_is_refused(rows, monkeypatch):
    monkeypatch.setattr(models, "ROW_LIMIT", 10)
    with pytest.raises(ValueError, match="10 rows"):
        trained(rows, [models.Fit("text", 0, kind="logistic")])


def brute_bayes(train, asked, labels, min_df=1, top=None):
    counts = {c: Counter() for c in labels}
    df, n = Counter(), Counter(label for label, _ in train)
    for label, terms in train:
        counts[label].update(terms)
        df.update(set(terms))
    total = Counter(t for _, terms in train for t in terms)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:top]
    out = []
    for terms in asked:
        score = {}
        for c in labels:
            mass = sum(counts[c][t] for t in kept)
            score[c] = math.log(n[c] + 1) + sum(math.log((counts[c][t] + 1) / (mass + len(kept))) for t in terms if t in set(kept)) if n[c] else -math.inf
        out.append(max(labels, key=lambda c: (score[c], -labels.index(c))))
    return out


def test_bayes_models_of_one_pass_equal_fits_one_by_one(rows):
    """Steps, settings and word pairs of several models come from one aggregation."""
    step = F.when(F.col("doc_id") < 12, 1).when(F.col("doc_id") < 24, 2).otherwise(3)
    settings = [("text", 1, 1, None), ("text", 2, 1, None), ("text", 3, 2, None), ("text", 3, 1, 5), ("text~2", 2, 2, None), ("text~2", 3, 1, 7)]
    found, tokens = trained(rows, [models.Fit(v, 0, s, min_df=low, max_features=top) for v, s, low, top in settings], [*LABELS, 4], step)
    data = sorted((r.doc_id, r.label, r.text) for r in rows.collect())

    def terms(text, variant):
        own = words(text)
        return own + [f"{a} {b}" for a, b in zip(own, own[1:])] if variant.endswith("~2") else own

    for m, (variant, last, low, top) in enumerate(settings):
        train = [(label, terms(text, variant)) for i, label, text in data if i < 12 * last]
        want = brute_bayes(train, [terms(text, variant) for *_, text in data], [*LABELS, 4], low, top)
        got = predicted(found, tokens, rows, variant, m)
        assert [got[i].prediction for i, *_ in data] == want, settings[m]


def test_rows_without_known_terms_and_training_rows(spark, rows):
    found, _ = trained(rows, [models.Fit("text", 0), models.Fit("text", 0, kind="logistic")])
    asked = spark.createDataFrame([(1, 1, "zebra"), (2, 1, ""), (3, 1, None), (4, 1, "cat zebra")], "doc_id BIGINT, label INT, text STRING")
    tokens = models.long_tokens(asked, ["text"])
    for model in (0, 1):
        got = predicted(found, tokens, asked, model=model)
        assert got[1].margins == got[2].margins == got[3].margins == pytest.approx(found.intercepts[model])
        assert got[4].prediction == 1
    train = spark.createDataFrame([(4, 0)], "id BIGINT, seed INT")
    left = models.predict(found, tokens, asked.select(F.col("doc_id").alias("id"), "label"), [("x", 0, "text")], train)
    assert sorted(r.id for r in left.collect()) == [1, 2, 3]


def test_saved_models_come_back(spark, rows, tmp_path):
    found, tokens = trained(rows, [models.Fit("text", 0, min_df=2), models.Fit("text", 0, kind="logistic", c=3.0)])
    found.save(f"{tmp_path}/m")
    back = models.load(spark, f"{tmp_path}/m")
    assert (back.fits, back.labels, back.intercepts) == (found.fits, found.labels, found.intercepts)
    assert sorted(back.terms.collect()) == sorted(found.terms.collect())
    assert predicted(back, tokens, rows, model=1) == predicted(found, tokens, rows, model=1)
    with pytest.raises(Exception, match="(?i)exist"):
        found.save(f"{tmp_path}/m")


def test_split_of_samples_equals_sample_then_split(spark):
    ids = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7 % 3).cast("int").alias("label"))
    for n in (120, 300):
        got = sorted(tuple(r) for r in sampling.split_samples(ids, n, (0, 5)).select("doc_id", "label", "seed", "side").collect())
        want = [sampling.stratified_split(sampling.sample_n(ids, n, s), seeds=(s,)).select("doc_id", "label", "seed", "side") for s in (0, 5)]
        assert got == sorted(tuple(r) for df in want for r in df.collect())


def test_run_shares_fit_and_split_and_scores_all_other_rows(spark, rows):
    df = rows.withColumn("repaired", F.regexp_replace("text", "39", ""))
    found = experiment.run(df, experiment.two_by_two(), LABELS, "t", (0, 1), 30, "bayes")
    experiment.check_run(found.results)
    expected = found.results.select("seed", "cell", F.col("macro_f1").alias("value"))
    experiment.check_run(found.results, expected)
    with pytest.raises(AssertionError, match="deviate"):
        experiment.check_run(found.results, expected.withColumn("value", F.col("value") + 0.1))
    trained_on = {(r.seed, r.id) for r in found.train.collect()}
    scored = {(r.seed, r.id) for r in found.predictions.filter("cell = 'A'").collect()}
    assert not trained_on & scored and len(trained_on | scored) == 2 * 36 and len(trained_on) == 2 * 24
    assert {r.vocab_size for r in found.results.filter("seed = 0 and cell in ('A', 'B')").collect()}.__len__() == 1
    assert experiment.summary(found.results).count() == 4


def test_silenced_token_keeps_its_share_of_the_norm(rows):
    found, tokens = trained(rows, [models.Fit("text", 0, kind="logistic")])
    full, quiet = predicted(found, tokens, rows)[2], predicted(found.silenced("cat"), tokens, rows)[2]
    w = term_weights(found)
    x = unit_rows([text for _, text in TEXTS * 4])[2]
    assert full.margins == pytest.approx([sum(v * w[t][c] for t, v in x.items()) + found.intercepts[0][c] for c in range(3)])
    assert quiet.margins == pytest.approx([x["mat"] * w["mat"][c] + found.intercepts[0][c] for c in range(3)])


def test_token_ablation_adds_up(rows):
    df = rows.withColumn("repaired", F.col("text"))
    found = experiment.token_ablation(df, "39", LABELS, (0,), 30, "bayes")
    cells = {r.cell: r.value for r in found.collect()}
    assert set(cells) == {"A", "B", "P", "Z"} and cells["A"] == cells["B"] == cells["P"]


def test_batch_scores_flag_and_reject(spark, rows):
    found, _ = trained(rows, [models.Fit("text", 0, kind="logistic")])
    asked = spark.createDataFrame([(1, "cat zebra"), (2, ""), (3, "cat " * 1300), (4, "cat mat " * 20)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in experiment.batch_score(found, 0, asked).collect()}
    assert got[1].oov_fraction == 0.5 and got[1].below_training_length_floor and got[1].prediction == 1 and 1 / 3 < got[1].confidence < 1
    assert got[2].rejected and got[2].prediction is None and got[2].oov_fraction is None
    assert got[3].rejected and got[3].prediction is None
    assert not got[4].below_training_length_floor and got[4].prediction == 1


def test_learning_curve_equals_fits_step_by_step(rows):
    df = rows.withColumn("repaired", F.col("text"))
    found = experiment.learning_curve(df, LABELS, (6, 12), anchors=(1, 2), anchor_rows=6, seeds=(0, 3))
    got = {(r.anchor, r.seed, r.step): (r.macro_f1, r.vocab_size) for r in found.collect()}
    assert len(got) == 8
    ids = df.select("doc_id", "label")
    held = {a: {r.doc_id for r in sampling.sample_n(ids, 6, a).collect()} for a in (1, 2)}
    data = {r.doc_id: (r.label, words(r.text)) for r in df.collect()}
    pool = ids.filter(~F.col("doc_id").isin(list(held[1] | held[2])))
    for seed in (0, 3):
        for step in (6, 12):
            inside = [r.doc_id for r in sampling.nested_prefixes(pool, (6, 12), (seed,)).filter(F.col("step") <= step).collect()]
            train = [data[i] for i in inside]
            for a in (1, 2):
                asked = sorted(held[a])
                want = brute_bayes(train, [data[i][1] for i in asked], LABELS)
                pairs = df.sparkSession.createDataFrame([(0, data[i][0], p) for i, p in zip(asked, want)], "seed INT, label INT, prediction INT")
                f1 = scores.macro_f1(pairs, ["seed"]).first().macro_f1
                assert got[a, seed, step] == (pytest.approx(f1), len({t for _, terms in train for t in terms}))


def test_held_out_numbers_come_through_the_guard(spark, rows, tmp_path):
    path = f"{tmp_path}/held"
    rows.limit(12).select("label", F.lit("t").alias("title"), "text").write.option("escape", '"').csv(path)
    with pytest.raises(RuntimeError, match="i_am_sure"):
        corpus.load_quarantined(spark, path, rows=12, domain=LABELS)
    with pytest.raises(ValueError, match="expected 13 rows"):
        corpus.load_quarantined(spark, path, i_am_sure=True, rows=13, domain=LABELS)
    held = corpus.load_quarantined(spark, path, i_am_sure=True, rows=12, domain=LABELS)
    found, _ = trained(rows, [models.Fit("text", 0)])
    numbers = experiment.held_out_numbers(found, held, [("text", 0)]).collect()
    assert [(r.cell, r.macro_f1) for r in numbers] == [("text", 1.0)]


def test_vocabulary_sizes_cover_the_training_side_of_all_rows(spark, tmp_path):
    data = [(i, f"title {i}\nword{i} & more{i % 3}", "en fr de es".split()[i % 4], "s") for i in range(40)] + [(40, None, "en", "s"), (40, "twice", "en", "s")]
    spark.createDataFrame(data, "doc_id BIGINT, text STRING, lang STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    judged = [(i, i % 2) for i in range(10)]  # the others count all the same
    spark.createDataFrame(judged, "doc_id BIGINT, quality INT").write.parquet(f"{tmp_path}/labels.parquet")
    split = sampling.stratified_split(inputs.dirty_corpus(spark, str(tmp_path))).filter("side = 'train'").collect()
    want = {(seed, cell): len({w for r in split if r.seed == seed for w in words(r[column])})
            for seed in sampling.SEEDS for column, cells in (("text", "AB"), ("repaired", "CD")) for cell in cells}
    got = {(r.seed, r.cell): r.value for r in queries.train_vocab_sizes(spark, str(tmp_path)).collect()}
    assert got == want and min(got.values()) > 40


def test_scoring_moves_no_token_while_weights_can_be_broadcast(rows, monkeypatch):
    found, tokens = trained(rows, [models.Fit("text", 0), models.Fit("text", 0, kind="logistic")])
    asks = [(f"x{m}", m, "text") for m in range(2)]
    ids = rows.select(F.col("doc_id").alias("id"), "label")

    def scored():
        out = models.predict(found, tokens, ids, asks)
        return {(r.id, r.cell): r.margins for r in out.collect()}, out._jdf.queryExecution().optimizedPlan().toString()

    one, plan = scored()
    assert plan.count("strategy=broadcast") >= 4
    monkeypatch.setattr(models, "WIDE_VALUES", 0)
    shuffled, _ = scored()
    monkeypatch.setattr(models, "PLACES", 1)  # a pass for every model
    alone, _ = scored()
    assert len(one) == 2 * len(TEXTS) * 4
    for other in (shuffled, alone):
        assert other.keys() == one.keys() and all(other[x] == pytest.approx(one[x]) for x in one)


def test_linear_fit_of_rows_that_repeat_an_id(rows):
    found, _ = trained(rows.unionByName(rows.filter("doc_id < 9")), [models.Fit("text", 0, kind="logistic")])
    assert {"cat", "stocks", "naïve"} <= set(term_weights(found))


def test_a_linear_fit_leaves_only_its_terms_behind(spark):
    from pathlib import Path

    from textassay.session import settle, shared_folder

    rows = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} word", k % 2) for k in range(40)], "doc_id long, text string, label int")
    tokens = models.long_tokens(rows, ["text"])
    train = settle(rows.selectExpr("doc_id AS id", "0 AS seed", "0 AS step", "label"))
    folder = Path(shared_folder(spark).removeprefix("file://")) / "textassay"
    before = set(folder.iterdir())
    fitted = models.fit(tokens, train, [models.Fit("text", 0, kind="logistic")], [0, 1])
    assert len(set(folder.iterdir()) - before) == 1
    assert fitted.terms.count() == 8


def test_long_tokens_count_every_row_for_itself(spark):
    """Rows beyond one slice of a batch, repeated and null ids, null and empty texts, two variants."""
    texts = ["b a b", None, "", "x", "the the cat"]
    data = [(None if i % 7 == 0 else i // 2, texts[i % 5], texts[(i + 1) % 5]) for i in range(2 * models.BATCH_ROWS + 9)]
    data = [(i, *(t and t.replace("b", "bb").replace("a", "aa") for t in pair)) for i, *pair in data]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING, other STRING").coalesce(1)
    want = Counter((i, name, term, n) for i, *pair in data for name, text in zip(("text", "other"), pair) for term, n in Counter(words(text or "")).items())
    found = models.long_tokens(df, ["other", "text"])
    assert found.dtypes == [("id", "bigint"), ("variant", "string"), ("term", "string"), ("tf", "int")]
    assert Counter(tuple(r) for r in found.collect()) == want
    assert {r.term for r in models.long_tokens(df, ["text~2"]).collect()} >= {"the caat", "the the", "caat"}
