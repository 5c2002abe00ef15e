"""CSV corpora with their contracts, and the results log."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textassay.functions import patterns, repair
from textassay.operators import checks, corruption, neardup, sampling
from textassay.plans import experiment
from textassay.sources import corpus, results

LINES = [
    '1,"He said ""hi"", then left","line one\nline two"',
    "2,\t padded \t, NA ",
    '3,NA,plain #39;s',
    '4,"","empty title"',
]


def write(tmp_path, lines, name="c.csv"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_quotes_newlines_and_odd_values(spark, tmp_path):
    rows = corpus.load_train(spark, write(tmp_path, LINES), rows=4, per_class=1).orderBy("label").collect()
    assert [r.text for r in rows] == [
        'He said "hi", then left line one\nline two', "padded NA", "NA plain #39;s", " empty title",
    ]
    assert [r.class_name for r in rows] == ["World", "Sports", "Business", "Sci-Tech"]


@pytest.mark.parametrize("lines, message", [
    (LINES[:3], "expected 4 rows"),
    ([*LINES[:3], "5,a,b"], "unexpected labels"),
    ([*LINES[:3], "3,a,b"], "class balance"),
])
def test_broken_contracts(spark, tmp_path, lines, message):
    with pytest.raises(ValueError, match=message):
        corpus.load_train(spark, write(tmp_path, lines), rows=4, per_class=1)


def test_held_out_rows_need_consent(spark, tmp_path):
    path = write(tmp_path, LINES)
    with pytest.raises(RuntimeError, match="held-out"):
        corpus.load_quarantined(spark, path)
    assert corpus.load_quarantined(spark, path, i_am_sure=True, rows=4).count() == 4


def test_sum_identity_and_reproduction(spark, tmp_path):
    df = corpus.read_labelled_csv(spark, write(tmp_path, LINES))
    checks.require_sum_identity(df, patterns.corrupt(F.col("text")))
    marks = corruption.reproduces(corruption.provenance_grid(df), 1).collect()
    assert [r.reproduces for r in marks] == [True, True]
    assert checks.labels_outside(df, [1, 2, 3]).collect()[0].label == 4
    assert checks.unbalanced(df, 1).count() == 0


def test_results_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("e", "A", 0, 0.5, 10), ("e", "B", 0, 0.6, 10), ("dummy", "dummy", 0, 0.1, None)],
        "experiment STRING, cell STRING, seed INT, macro_f1 DOUBLE, vocab_size INT",
    )
    path = str(tmp_path / "log")
    results.write_results(results.with_provenance(rows, "r1", "abc"), path)
    got = {(r.seed, r.cell): r.value for r in results.read_cells(spark, path, "e").collect()}
    assert got == {(0, "A"): 0.5, (0, "B"): 0.6}
    assert {r.value for r in results.read_cells(spark, path, "e", "vocab_size").collect()} == {10}
    assert {r.run_id for r in results.read_results(spark, path).collect()} == {"r1"}
    with pytest.raises(KeyError, match="seed 0 has no 'vocab_size'"):
        results.read_cells(spark, path, "dummy", "vocab_size")
    with pytest.raises(LookupError, match="nope"):
        results.read_cells(spark, path, "nope")
    with pytest.raises(AnalysisException):
        results.write_results(rows, path)


def test_results_log_skips_blank_lines_and_refuses_repeats(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"experiment": "e", "cell": "A", "seed": 0, "macro_f1": 0.5}\n\n'
                    '{"experiment": "e", "cell": "A", "seed": 1, "macro_f1": 0.7}\n')
    assert results.read_cells(spark, str(path), "e").count() == 2
    path.write_text('{"experiment": "e", "cell": "A", "seed": 0, "macro_f1": 0.5}\n' * 2)
    with pytest.raises(ValueError, match="more than once"):
        results.read_cells(spark, str(path), "e")


def test_union_fills_absent_columns(spark):
    both = results.union_results(spark.range(1).toDF("id"), spark.range(1).toDF("id").withColumn("x", F.lit(2)))
    assert sorted(r.x or 0 for r in both.collect()) == [0, 2]
    assert results.as_json(both).count() == 2


def test_row_ids_are_unique_and_depend_on_content_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "COPIES_PER_TASK", 4)
    lines = [*LINES, *[LINES[2]] * 30, '1,,""', "1,b,a"]
    found = corpus.read_labelled_csv(spark, write(tmp_path, lines)).collect()
    assert len(found) == len(lines) and len({r.doc_id for r in found}) == len(lines)
    again = corpus.read_labelled_csv(spark, write(tmp_path, lines[::-1], "reversed.csv")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_a_loaded_corpus_runs_through_the_library(spark, tmp_path):
    """Load, repair, sample, compare and fingerprint, as the README shows it."""
    topics = {1: "army border treaty", 2: "match goal league", 3: "stock price market", 4: "chip code robot"}
    lines = [f"{label},{words.split()[k % 3]} {k},{words} #39;s number{k % 7} {words}" for label, words in topics.items() for k in range(30)]
    lines += [lines[0]] * 3
    df = corpus.read_labelled_csv(spark, write(tmp_path, lines))
    both = df.withColumn("repaired", repair.repair(F.col("text")))
    found = experiment.run(both, experiment.two_by_two(), [1, 2, 3, 4], "check", (0, 1), 100, "bayes").results
    experiment.check_run(found)
    assert {r.cell for r in found.collect()} == {"A", "B", "C", "D"}
    assert len(experiment.summary(found).collect()) == 4
    assert sampling.fingerprint(both, []).count() == 1
    grouped = neardup.groups(both)
    assert grouped.agg(F.sum("n")).first()[0] == len(lines)


def test_a_contract_is_checked_in_the_pass_that_reads(spark, tmp_path):
    """The loaded frame is settled rows; the files are not opened again, and counts come with the first pass."""
    path = write(tmp_path, LINES)
    df = corpus.load_train(spark, path, rows=4, per_class=1)
    assert not any(str(path) in file for file in df.inputFiles())
    seen, numbers = checks.observed(corpus.raw_csv(spark, path), [1, 2, 9])
    seen.write.format("noop").mode("overwrite").save()
    assert numbers.get["rows"] == 4 and numbers.get["n0"] == 1 and numbers.get["n2"] == 0 and numbers.get["stray"] == "3"
