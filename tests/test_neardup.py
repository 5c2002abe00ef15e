"""Near-duplicates against brute force, with a third of the rows being copies."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textassay.operators import keyed, neardup

TAU = 0.5


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(120)]
    out = list(base)
    for text in base[:40]:  # near copies
        parts = text.split()
        parts[rng.randrange(len(parts))] = rng.choice(words)
        out.append(" ".join(parts))
    out += [base[0]] * 90 + [base[1] + " zzz"] * 5 + ["rare only", ""]
    return out


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5)


@pytest.fixture(scope="module")
def brute(texts):
    first, n = {}, Counter(texts)
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    counts = {i: Counter(re.findall(r"\w\w+", text)) for text, i in first.items()}
    df = Counter(term for c in counts.values() for term in c)
    vec = {}
    for i, c in counts.items():
        w = {t: tf * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if w:
            vec[i] = {t: x / norm for t, x in w.items()}
    rows = []  # row pairs, the long way round
    ids = [first[text] for text in texts]
    for a, b in combinations(range(len(texts)), 2):
        u, v = ids[a], ids[b]
        same = u == v
        cos = sum(x * vec[v].get(t, 0) for t, x in vec[u].items()) if u in vec and v in vec else 0
        if same or cos >= TAU - 1e-9:
            rows.append((a, b, 1.0 if same else cos))
    return rows


def test_counts_equal_brute_force(spark, df, brute, texts):
    grouped = neardup.groups(df)
    pairs = neardup.similar_pairs(grouped, TAU)
    row = {r.threshold: r for r in neardup.sweep(grouped, pairs, (TAU, 0.9)).collect()}
    for t in (TAU, 0.9):
        at = [(a, b) for a, b, cos in brute if cos >= t - 1e-9]
        assert row[t].n_pairs == len(at)
        assert row[t].rows_involved == len({i for pair in at for i in pair})

    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b, _ in brute:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    sizes = Counter(root(i) for i in range(len(texts)))
    units = neardup.duplicate_units(grouped, neardup.clusters(pairs)).first()
    big = [n for n in sizes.values() if n > 1]
    assert (units.n_clusters, units.rows_involved, units.rows_beyond_first) == (len(big), sum(big), sum(big) - len(big))


def test_cross_split_equals_brute_force(df, brute):
    side = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    sums = {f"n_{s}": (side == s).cast("bigint") for s in ("train", "test")}
    grouped = neardup.groups(df, sums=sums)
    got = neardup.cross_split(grouped, neardup.similar_pairs(grouped, TAU)).first().n_cross_pairs
    assert got == sum((a % 5 == 0) != (b % 5 == 0) for a, b, _ in brute)


def family_texts(seed: int, n: int, share: float, spread: int) -> list[str]:
    """Texts of which a share are near copies of one: up to ``spread`` of its 60 words are others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2_000)]
    first = rng.choices(words, k=60)
    out = []
    for _ in range(n):
        if rng.random() < share:
            text = list(first)
            for _ in range(rng.randint(0, spread)):
                text[rng.randrange(60)] = rng.choice(words)
        else:
            text = rng.choices(words, k=rng.randint(10, 80))
        out.append(" ".join(text))
    return out


def brute_cosines(texts: list[str]) -> dict[tuple[int, int], float]:
    """All pairs of distinct bags of words that share a term, by the ids of their first texts."""
    first: dict = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    counts = {i: Counter(re.findall(r"\w\w+", text)) for text, i in first.items()}
    df = Counter(term for c in counts.values() for term in c)
    vec, bags = {}, {}
    for i, c in counts.items():
        bags.setdefault(frozenset(c.items()), i)
    for i in bags.values():
        w = {t: tf * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, tf in counts[i].items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[i] = {t: x / norm for t, x in w.items()}
    return {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) for a, b in combinations(sorted(vec), 2)}


def components(pairs) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in list(parent)}


def test_a_family_of_a_third_is_found_whole_with_few_links(spark):
    """Near copies are a third of the texts: every pair is found, and clusters need few links a member."""
    texts = family_texts(5, 400, 1 / 3, 2)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4))
    cosine = brute_cosines(texts)
    expected = {pair for pair, cos in cosine.items() if cos >= 0.8}
    assert len(expected) > 3_000
    assert {(r.a, r.b) for r in neardup.similar_pairs(grouped, 0.8).collect()} == expected
    links = [(r.a, r.b) for r in neardup.linked(grouped, 0.8, crowd=8).collect()]
    assert set(links) <= expected and components(links) == components(expected)
    assert len(links) < 10 * len(components(expected))


@pytest.mark.parametrize(("seed", "spread", "threshold"), [(1, 25, 0.8), (4, 60, 0.6)])
def test_links_of_wide_families_connect_what_pairs_connect(spark, seed, spread, threshold):
    """Families wider than a leader reaches: members of two families must still be compared."""
    texts = family_texts(seed, 160, 0.7, spread)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4))
    expected = {pair for pair, cos in brute_cosines(texts).items() if cos >= threshold}
    links = [(r.a, r.b) for r in neardup.linked(grouped, threshold, crowd=8).collect()]
    assert set(links) <= expected and components(links) == components(expected)


def test_frequent_index_terms_are_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MIN_HEAVY_ROWS", 5)
    texts = family_texts(9, 80, 0.5, 6)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    expected = {pair for pair, cos in brute_cosines(texts).items() if cos >= 0.8}
    found = [(r.a, r.b) for r in neardup.similar_pairs(grouped, 0.8).collect()]
    assert sorted(found) == sorted(expected)


def test_title_pairs(spark):
    rows = [(7, "x"), (3, "x"), (9, "x"), (1, "y"), (2, "y"), (4, "z")] + [(100 + i, "hot") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, title STRING")
    got = {(r.a, r.b) for r in neardup.title_pairs(df).collect()}
    assert got == {(3, 7), (3, 9), (7, 9), (1, 2)}


def test_clusters_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r.id: r.cluster for r in neardup.clusters(spark.createDataFrame(chain + star, "a BIGINT, b BIGINT")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_no_pairs_give_no_clusters(spark):
    assert neardup.clusters(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_heavy_keys_are_cut_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MIN_HEAVY_ROWS", 10)
    monkeypatch.setattr(keyed, "HEAVY_SHARE", 20)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("term"))
    lookup = rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("x", F.length("term"))
    pieces = {r.term: r._pieces for r in keyed.heavy_keys(lookup, "term", "df").collect()}
    assert pieces == {"hot": 7}
    joined = keyed.join_by_frequency(rows, lookup, "term", "df", "doc_id")
    assert sorted((r.doc_id, r.x) for r in joined.collect()) == sorted(
        (i, 3 if i % 3 == 0 else len(f"k{i % 97}")) for i in range(1000))


def test_blocks_and_strips_lose_no_pair(spark, monkeypatch):
    """Vectors in blocks of a few, compared in strips of one row and a few meetings at a time; common terms decide some pairs."""
    for name, value in (("BLOCK", 12), ("STRIP_CELLS", 1), ("MEETINGS", 7), ("COMMON", 0.9)):
        monkeypatch.setattr(neardup, name, value)
    texts = family_texts(7, 60, 0.5, 6)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    expected = {pair: cos for pair, cos in brute_cosines(texts).items() if cos >= 0.7}
    found = {(r.a, r.b): r.cosine for r in neardup.similar_pairs(grouped, 0.7).collect()}
    assert found == pytest.approx(expected)


def test_groups_of_blocks_lose_no_pair_and_rare_terms_stand_in_for_all(spark, monkeypatch):
    """Many blocks and groups of blocks; only rare terms are met, and what hangs together is compared but once."""
    for name, value in (("BLOCK", 10), ("COLUMN_BLOCKS", 2), ("STRIP_CELLS", 40), ("SPARSE", 4), ("BLOCK_TERMS", 150)):
        monkeypatch.setattr(neardup, name, value)
    texts = family_texts(11, 120, 0.6, 12)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    for threshold in (0.8, 0.6):
        expected = {pair: cos for pair, cos in brute_cosines(texts).items() if cos >= threshold}
        found = {(r.a, r.b): r.cosine for r in neardup.similar_pairs(grouped, threshold).collect()}
        assert found == pytest.approx(expected) and len(found) > 50
        links = [(r.a, r.b) for r in neardup.linked(grouped, threshold, crowd=3).collect()]
        assert set(links) <= set(expected) and components(links) == components(expected)


@pytest.mark.parametrize(("meetings", "sparse"), [(7, 0), (1 << 20, 1_000_000), (1 << 20, 0), (7, 2)])
def test_candidates_hold_every_pair_however_sums_are_held(spark, monkeypatch, meetings, sparse):
    """Sums in pieces, in all columns or in those met alone; rows of a block against a group that holds it and one behind it."""
    for name, value in (("BLOCK_TERMS", 900), ("STRIP_CELLS", 100), ("MEETINGS", meetings), ("SPARSE", sparse)):
        monkeypatch.setattr(neardup, name, value)
    texts = family_texts(12, 120, 0.5, 10)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    expected = {pair for pair, cos in brute_cosines(texts).items() if cos >= 0.8}
    folder, blocks = neardup._blocks(grouped.select("id", "vec"), 0.8)
    found = set()
    assert len(blocks) > 4
    for group in (blocks[:3], blocks[3:]):
        index = neardup._Index(folder, group)
        ids = [i for number in group for i in neardup._read(folder, number, ["id"])["id"].to_pylist()]
        for number in blocks[: blocks.index(group[-1]) + 1]:
            table = neardup._read(folder, number, ["id", "head", "head_w", "behind"])
            x, y = neardup._candidates(table, index, index.first.get(number), 0.8)
            pairs = [tuple(sorted((table["id"][int(r)].as_py(), ids[c]))) for r, c in zip(x, y)]
            assert len(set(pairs)) == len(pairs) and not found & set(pairs)
            found |= set(pairs)
    assert expected <= found and len(expected) > 50 and len(found) < 120 * 119 // 2


def test_links_of_one_task_are_fewer_than_its_vectors(spark):
    texts = family_texts(6, 200, 0.8, 2)
    grouped = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"))
    found = components((r.a, r.b) for r in neardup.similar_pairs(grouped, 0.8).collect())
    links = neardup.linked(grouped, 0.8)
    assert links.count() == len(found) - len(set(found.values()))


def test_repeated_ids_are_an_error(spark):
    rows = [(1, "some words of a text"), (1, "some words of a text"), (2, "some words of another")]
    grouped = neardup.groups(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    with pytest.raises(Exception, match="unique ids"):
        neardup.similar_pairs(grouped, 0.8).count()


def test_pairs_leave_only_groups_and_pairs_behind(spark):
    """Texts, weights and blocks go when nothing reads them any more."""
    from pathlib import Path

    from textassay.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://")) / "textassay"
    rows = spark.createDataFrame([(i, f"one two three four five w{i // 2}") for i in range(12)] + [(99, "")], "doc_id BIGINT, text STRING")
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    grouped = neardup.groups(rows)
    pairs = neardup.similar_pairs(grouped, 0.5)
    listed = {f.removeprefix("file://") for frame in (grouped, pairs) for f in frame.inputFiles()}
    kept = sum(Path(f.replace("file:", "")).stat().st_size for f in listed)
    assert pairs.count() > 0 and grouped.count() == 7
    assert size() - before == kept
