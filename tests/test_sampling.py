"""Samples, splits and fingerprints against brute force in Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textassay.operators import sampling


def place(row_id, seed):
    return (hashlib.md5(f"{row_id}:{seed}".encode()).hexdigest(), row_id)


@pytest.fixture(scope="module")
def rows(spark):
    # Label 1 holds more than a third of the rows; label 5 has a single one.
    label = F.when(F.col("doc_id") == 0, 5).when(F.col("doc_id") % 2 == 0, 1).otherwise(F.col("doc_id") % 4)
    return spark.range(1003).withColumnRenamed("id", "doc_id").withColumn("label", label.cast("int")).repartition(7)


@pytest.mark.parametrize("n", [1, 37, 500, 1002])
def test_sample_is_exact(rows, n):
    got = {row.doc_id for row in sampling.sample_n(rows, n, 3).collect()}
    assert got == set(sorted(range(1003), key=lambda i: place(i, 3))[:n])


def test_sample_of_more_rows_than_there_are(rows):
    with pytest.raises(ValueError, match="without replacement"):
        sampling.sample_n(rows, 1004, 0)


def test_sample_does_not_depend_on_partitions(rows):
    a = {r.doc_id for r in sampling.sample_n(rows.coalesce(1), 100, 0).collect()}
    assert a == {r.doc_id for r in sampling.sample_n(rows.repartition(13), 100, 0).collect()}


def test_split_is_stratified_exact_and_seeded(rows):
    labels = {r.doc_id: r.label for r in rows.collect()}
    split = sampling.stratified_split(rows, seeds=(0, 1)).collect()
    assert len(split) == 2 * 1003
    per_label = Counter(labels.values())
    for seed in (0, 1):
        test = [r for r in split if r.seed == seed and r.side == "test"]
        assert len(test) == -(-1003 * 20 // 100)
        by_label = defaultdict(list)
        for i in labels:
            by_label[labels[i]].append(i)
        for label, n in per_label.items():
            got = {r.doc_id for r in test if r.label == label}
            assert abs(len(got) - n / 5) < 1
            assert got == set(sorted(by_label[label], key=lambda i: place(i, seed))[:len(got)])


def test_prefixes_are_nested_and_exact(rows):
    got = sampling.nested_prefixes(rows, (10, 100, 640), seeds=(4,)).collect()
    order = sorted(range(1003), key=lambda i: place(i, 4))
    want = {i: next((k for k in (10, 100, 640) if rank < k), None) for rank, i in enumerate(order)}
    assert {r.doc_id: r.step for r in got} == want


def test_prefix_that_exhausts_the_pool(rows):
    with pytest.raises(ValueError, match="exhausts"):
        sampling.nested_prefixes(rows, (10, 1003))


def brute_tree(ids, id_bits, fan_bits):
    level = defaultdict(list)
    for i in sorted(ids):
        level[i >> id_bits].append(str(i))
    digest = {k: hashlib.sha1(",".join(v).encode()).hexdigest() for k, v in level.items()}
    left = 64 - id_bits
    while left > 0:
        up = defaultdict(list)
        for k in sorted(digest):
            up[k >> min(fan_bits, left)].append(digest[k])
        digest = {k: v[0] if len(v) == 1 else hashlib.sha1(",".join(v).encode()).hexdigest() for k, v in up.items()}
        left -= fan_bits
    parts = [digest[k] for k in sorted(digest)]
    return (parts[0] if len(parts) == 1 else hashlib.sha1(",".join(parts).encode()).hexdigest())[:12]


def test_fingerprint_of_small_sets_is_the_plain_digest(rows):
    got = sampling.fingerprint(rows.withColumn("g", F.lit(1)), ["g"]).first().fingerprint
    assert got == hashlib.sha1(",".join(map(str, range(1003))).encode()).hexdigest()[:12]


def test_fingerprint_tree(rows):
    shifted = rows.select((F.col("doc_id") * 17 - 40).alias("doc_id"), F.lit(1).alias("g"))
    got = sampling.fingerprint(shifted, ["g"], id_bits=5, fan_bits=3).first().fingerprint
    assert got == brute_tree([i * 17 - 40 for i in range(1003)], 5, 3)
    other = sampling.fingerprint(shifted.filter("doc_id <> 300"), ["g"], id_bits=5, fan_bits=3).first().fingerprint
    assert other != got


def test_review_sheet_has_no_label(rows):
    sheet = sampling.review_sheet(rows.withColumn("text", F.lit("x")), 10)
    assert sheet.columns == ["doc_id", "text"] and sheet.count() == 10
