"""Decontamination, suffix dedup, SimHash and quality rules against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import odd
from textassay.llm import phrases, quality, simhash, suffix

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SOLID = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute_hits(texts, items, window=10):
    known = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            known.setdefault(tuple(own[k : k + window]), set()).add(item)
    out = {}
    for doc, text in texts:
        own, hit, found = words(text), set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(own) - n + 1):
                if items_here := known.get(tuple(own[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_here
        out[doc] = (len(own), len(hit), sorted(map(str, found - {None})), bool(hit))
    return out


ITEMS = [(1, odd.LINE), (2, "seven wizards"), (3, None), (4, ""), (10, odd.LINE + " again and again"), (None, "naïve café naïve"), (5, "w7 w8"), (5, "w7 w8")]


@pytest.mark.parametrize("block", [50_000, 2])
def test_contamination(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = phrases.contamination(odd.documents(spark), items, block_windows=block).collect()
    expected = brute_hits([(k if k != 2 else None, t) for k, t in enumerate(odd.TEXTS)], ITEMS)
    assert len(found) == len(odd.TEXTS)
    for row in found:
        assert (row.n_words, row.n_hit, row.item_ids, row.contaminated) == expected[row.doc_id], row.doc_id


def test_index_is_written_in_small_pieces(spark):
    from pyarrow import parquet

    some = random.Random(1)
    texts = [(k, " ".join(f"{some.getrandbits(40):x}" for _ in range(180_000))) for k in range(24)]
    index = phrases.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    groups = [parquet.ParquetFile(x.removeprefix("file:")).metadata for x in index.inputFiles()]
    sizes = [found.row_group(k).total_byte_size for found in groups for k in range(found.num_row_groups)]
    assert sum(sizes) > 50_000_000 and max(sizes) < 20_000_000


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert phrases.contamination(odd.empty(spark), items).count() == 0
    clean = phrases.contamination(odd.documents(spark), items.limit(0)).collect()
    assert len(clean) == len(odd.TEXTS) and not any(row.contaminated for row in clean)


def test_phrases_and_proximity(spark):
    docs = odd.documents(spark, ["a b c d e", "a x b c d e", "e d c b a", "a b", "b c d e f a b c d e"])
    windows = phrases.test_windows(spark.createDataFrame([(7, "a b c d e")], "item_id long, text string"))
    index = phrases.build_index(docs)
    exact = sorted((r.doc_id, r.item_id, r.start, r.n_words) for r in phrases.matches(index, windows).collect())
    assert exact == [(0, 7, 0, 5), (4, 7, 5, 5)]
    near = {r.doc_id for r in phrases.matches(index, windows, slop=1).collect()}
    assert near >= {0, 1, 4} and 3 not in near
    assert {r.doc_id for r in phrases.matches(index, windows, slop=4).collect()} >= {0, 1, 4}


def brute_near(docs, window, slop):
    """(document, start) wherever every word finds a place of its own near where the phrase has it."""
    count = Counter(x for doc in docs for x in doc)
    rarest = min(range(len(window)), key=lambda k: (count[window[k]], k))

    def served(doc, start, offset, used):
        if offset == len(window):
            return True
        if offset == rarest:
            return served(doc, start, offset + 1, used)
        low, high = max(0, start + offset - slop), min(len(doc) - 1, start + offset + slop)
        return any(
            doc[p] == window[offset] and p not in used and served(doc, start, offset + 1, used | {p}) for p in range(low, high + 1)
        )

    return sorted(
        (number, p - rarest) for number, doc in enumerate(docs) for p, x in enumerate(doc)
        if x == window[rarest] and served(doc, p - rarest, 0, {p})
    )


def test_proximity_equals_brute_force(spark):
    draw = random.Random(5)
    docs = [[draw.choice("aabbc") for _ in range(draw.randint(0, 14))] for _ in range(40)] + [["a", "x", "y"], ["a"] * 3]
    items = [[draw.choice("aabbc") for _ in range(draw.randint(1, 5))] for _ in range(12)] + [["a", "a"]]
    index = phrases.build_index(odd.documents(spark, [" ".join(x) for x in docs]))
    ids = {r.doc_id for r in phrases.documents(index).collect()}
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    windows = phrases.test_windows(texts)
    for slop in (0, 1, 2):
        found = {}
        for r in phrases.matches(index, windows, slop=slop).collect():
            found.setdefault(r.item_id, []).append((-1 if r.doc_id is None else r.doc_id, r.start))
        for k, item in enumerate(items):
            expected = [(d if d in ids else -1, at) for d, at in brute_near(docs, item, slop)]
            assert sorted(found.get(k, [])) == sorted(expected), (slop, item)


def brute_removed(rows):
    first, whole = {}, {}
    for doc, text in sorted((d, t or "") for d, t in rows if d is not None):
        data = text.encode()
        whole.setdefault(data, doc)
        for k in range(len(data) - suffix.LENGTH + 1):
            first.setdefault(data[k : k + suffix.LENGTH], doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if doc is not None:
            for k in range(len(data) - suffix.LENGTH + 1):
                if first[data[k : k + suffix.LENGTH]] < doc:
                    gone[k : k + suffix.LENGTH] = True
        left = bytes(b for b, g in zip(data, gone) if not g)
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(data), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), None if text is None else left.decode(errors="ignore")))
    return out


def repeats(seed, n=60):
    pick = np.random.default_rng(seed)
    passages = ["".join(pick.choice(list("ab é\n"), 70)) for _ in range(6)] + ["ab" * 50, "z" * 130]
    texts = []
    for _ in range(n):
        texts.append("".join(
            passages[pick.integers(len(passages))] if pick.random() < 0.5 else "".join(pick.choice(list("abc "), pick.integers(1, 60)))
            for _ in range(pick.integers(1, 5))
        ))
    return texts + texts[:7]


@pytest.mark.parametrize(("shard", "seed"), [(4 << 20, 1), (600, 1), (600, 2)])
def test_suffix_dedup(spark, monkeypatch, shard, seed):
    texts = odd.TEXTS + repeats(seed)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    ids = [None if k == 2 else (k * 37) % 101 for k in range(len(texts))]
    found = suffix.deduplicate(odd.documents(spark, texts, ids), texts=True).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_removed(list(zip(ids, texts))), key=str)


def test_suffix_dedup_of_empty_and_short_tables(spark):
    assert suffix.deduplicate(odd.empty(spark)).count() == 0
    short = suffix.deduplicate(odd.documents(spark, ["ab", "ab", None])).collect()
    assert [row.n_removed for row in short] == [0, 0, 0]


@settings(deadline=None, max_examples=40)
@given(st.text("ab", min_size=1, max_size=400), st.integers(0, 3))
def test_suffix_array_and_prefixes(text, times):
    data = np.frombuffer((text * (times + 1)).encode(), np.uint8)
    order, tied = suffix.suffix_array(data, 50)
    common = suffix.common_prefixes(data, order, tied, 50)
    raw = data.tobytes() + bytes(64)
    cut = [raw[k : k + 50] for k in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(data)))
    for k in range(1, len(order)):
        if min(len(data) - order[k], len(data) - order[k - 1]) >= 50:
            expected = next((n for n in range(50) if cut[k][n] != cut[k - 1][n]), 50)
            assert common[k] == expected


def brute_fingerprint(text):
    own = SOLID.findall((text or "").translate(LOWER))
    if not own:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(own[k : k + 3]).encode(), 42) for k in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(bits):
    """Fingerprint to smallest id, from (id, fingerprint)."""
    first = {}
    for doc, f in bits:
        if doc is not None:
            first[f] = min(doc, first.get(f, doc))
        else:
            first.setdefault(f, None)
    parent = {f: f for f in first}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(first, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for f, doc in first.items():
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return {f: least.get(root(f)) for f in first}


def test_near_duplicates(spark):
    near = [" ".join(f"v{k if k != j else -j}" for k in range(300)) for j in range(12)]
    texts = odd.TEXTS + near + near[:2]
    rows = simhash.near_duplicates(odd.documents(spark, texts)).collect()
    bits = [(None if k == 2 else k, brute_fingerprint(t)) for k, t in enumerate(texts)]
    groups = brute_components(bits)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((str(d), f"{f:016x}", groups[f]) for d, f in bits)
    assert len({groups[f] for _, f in bits}) < len({f for _, f in bits})
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [1_024, 4])
def test_links_connect_all_close_fingerprints(spark, bucket):
    pick = np.random.default_rng(3)
    centres = [int(x) for x in pick.integers(0, 1 << 62, 12)]
    bits = {c ^ sum(1 << int(b) for b in pick.choice(64, pick.integers(0, 4), replace=False)) for c in centres for _ in range(14)}
    frame = spark.createDataFrame([(simhash._signed(x),) for x in bits], "bits long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    close = {frozenset(x) for x in combinations(bits, 2) if (x[0] ^ x[1]).bit_count() <= 3}
    if bucket > len(bits):
        assert {frozenset(x) for x in found} == close

    def components(edges):
        parent = {x: x for x in bits}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        groups = {}
        for x in bits:
            groups.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert components(found) == components(close)


def brute_statistics(text):
    text = text or ""
    own = SOLID.findall(text)
    grams = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
    marked = {k + j for k in range(len(own) - 4) if grams[tuple(own[k : k + 5])] > 1 for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if SOLID.search(line):
            dups += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(c in quality.SYMBOLS for c in text), dups, len(marked)


def test_quality_statistics_and_verdicts(spark):
    texts = odd.TEXTS + ["# $ % &", "one two three four five\n" * 4, "a\n\na\n \nb", "|".join("abc")]
    rows = quality.judge(odd.documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    expected = {None if k == 2 else k: brute_statistics(t) for k, t in enumerate(texts)}
    for row in rows:
        n, *rest = expected[row.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, *rest)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        assert row.base_failed == failed and not (failed and row.kept)
    assert quality.judge(odd.empty(spark)).count() == 0


def brute_fit(v):
    """Concentration steps on whole rows, from medians and quartiles of the same grid."""
    least = np.square(quality.LEAST_SD)
    quart = [np.sort(v // 32, axis=0)[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.5, 0.75)]
    a, b, c = ((q * 32 + 16) / quality.SCALE if k == 1 else q * 32 / quality.SCALE for k, q in enumerate(quart))
    centre, precision, spread = b, np.diag(1 / (((c - a) / 1.349) ** 2 + least)), np.inf
    while True:
        off = v / quality.SCALE - centre
        bins = np.floor(np.log2(1 + np.einsum("ni,ij,nj->n", off, precision, off)) * 32)
        cut = np.sort(bins)[int(np.ceil(quality.SUBSET * len(v))) - 1]
        near = v[bins <= cut] / quality.SCALE
        scatter = np.cov(near.T, bias=True) * quality.CONSISTENCY + np.diag(least)
        if (now := np.linalg.slogdet(scatter)[1]) >= spread - 1e-9:
            return centre, precision
        centre, precision, spread = near.mean(axis=0), np.linalg.inv(scatter), now


def test_minimum_covariance_determinant(spark):
    pick = np.random.default_rng(5)
    values = pick.normal(0, 0.3, (800, 5)) @ pick.normal(0, 1, (5, 5)) + 2
    values[:120] += 9
    v = np.round(values * quality.SCALE).astype(int)
    rows = spark.createDataFrame([("g", x.tolist()) for x in v], "group string, v array<long>").repartition(3)
    fit = quality.estimates(rows).first()
    centre, precision = brute_fit(v)
    assert np.allclose(fit.centre, centre, atol=1e-6) and np.allclose(np.array(fit.precision).reshape(5, 5), precision, rtol=1e-5, atol=1e-6)
    off = values - np.array(fit.centre)
    far = np.einsum("ni,ij,nj->n", off, np.array(fit.precision).reshape(5, 5), off) > quality.CUTOFF
    assert far[:120].all() and far[120:].mean() < 0.01


def brute_judge(stats):
    """Distance of every row that passes, from the statistics: means, vectors, three levels of fits, shrinkage."""
    prior = quality.PRIOR_ROWS
    passed = [r for r in stats if r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    groups = {"g": lambda r: (r["lang"], r["source"]), "l": lambda r: r["lang"], "a": lambda r: 0}

    def total(rows, name):
        return float(sum(r[name] for r in rows))

    def means(row):
        out = {}
        for name, over, under in quality._MEANS:
            value = total(passed, over) / max(1.0, total(passed, under))
            added = prior * max(1e-9, total(passed, under) / len(passed))
            for level in "lg":
                own = [r for r in passed if groups[level](r) == groups[level](row)]
                value = (total(own, over) + added * value) / (total(own, under) + added)
            out[name] = max(1.0, value) if name == "length" else value
        return out

    def vector(r, m):
        drawn = lambda over, under, name, n: (r[over] + n * m[name]) / (r[under] + n)
        angle = lambda x: np.arcsin(np.sqrt(min(1.0, x)))
        return [
            np.log(drawn("word_chars", "n_words", "length", 50)), angle(drawn("n_symbols", "word_chars", "symbols", 300)),
            angle(drawn("n_dup_lines", "n_lines", "dups", 10)), angle(drawn("n_repeat_words", "n_words", "repeats", 50)),
            angle(drawn("n_echo_words", "n_words", "echoes", 50)),
        ]

    known = {groups["g"](r): means(r) for r in passed}
    v = np.array([np.round(np.array(vector(r, known[groups["g"](r)])) * quality.SCALE).astype(int) for r in passed])
    fits = {}
    for level, of in groups.items():
        for key in {of(r) for r in passed}:
            inside = np.array([of(r) == key for r in passed])
            fits[level, key] = (*brute_fit(v[inside]), int(inside.sum()))
    out = {}
    for r, x in zip(passed, v):
        centre, precision, _ = fits["a", 0]
        scatter = np.linalg.inv(precision)
        for level in "lg":
            own_centre, own_precision, n = fits[level, groups[level](r)]
            share, off = n / (n + prior), own_centre - centre
            scatter = share * np.linalg.inv(own_precision) + (1 - share) * scatter + share * (1 - share) * np.outer(off, off)
            centre = centre + share * off
        off = x / quality.SCALE - centre
        out[r["doc_id"]] = float(off @ np.linalg.inv(scatter) @ off)
    return out


def test_verdicts_of_groups_of_any_size(spark):
    """Groups of 1, 99, 100 and 300 documents, null groups, repeated rows: distances and verdicts as worked out by hand."""
    pick = np.random.default_rng(8)
    rows = []
    for size, lang, source in ((1, "en", "s0"), (99, "en", "s1"), (100, "en", "s2"), (300, "de", "s3"), (40, None, None), (1, "xx", "s0")):
        for k in range(size):
            own = ["".join(pick.choice(list("abcdefgh"), pick.integers(1, 9 if lang == "de" else 6))) for _ in range(pick.integers(8, 60))]
            own += ["#$"] * int(pick.integers(0, 3)) + (["so", "so"] if k % 3 else []) + (["%%%%"] * 25 if k % 17 == 5 else [])
            text = " ".join(own) + ("\nline here\nline here" if k % 4 == 0 else "")
            rows.append((len(rows), text, lang, source))
    rows += [(len(rows) + k, *rows[150][1:]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stats = [r.asDict() for r in quality.statistics(df).collect()]
    expected = brute_judge(stats)
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(found) == len(rows) and 0 < sum(not r.kept for r in found.values()) < len(rows) / 2
    for doc, row in found.items():
        if doc in expected:
            assert row.distance == pytest.approx(expected[doc], rel=1e-3, abs=1e-6)
            assert row.kept == (expected[doc] <= quality.CUTOFF)
        else:
            assert row.base_failed and not row.kept


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = judged.filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) < 0.6 * len(bad)


def test_strings_of_a_bucket_are_merged_in_passes(monkeypatch):
    """A bucket's memory is its texts and a little for each start, and passes change nothing."""
    import tracemalloc

    import zstandard

    rng = np.random.default_rng(4)
    pool = rng.integers(97, 123, 300_000, np.uint8)
    blobs, texts = [], []
    for shard in range(4):  # one long piece and a short one each, of one text for all
        pieces = [(int(rng.integers(0, 40_000)), 200_000, 10 - shard), (int(rng.integers(0, 200_000)), 40, 20 + shard)]
        texts.append([(1_000_000 * k, pool[at : at + n + suffix.LENGTH - 1], n, document) for k, (at, n, document) in enumerate(pieces)])
        head = np.array([[len(pieces)], *([x] for piece in zip(*[(p, n, d) for p, _, n, d in texts[-1]]) for x in piece)], "<i8").ravel()
        blobs.append(zstandard.ZstdCompressor().compress(head.tobytes() + b"".join(text.tobytes() for _, text, _, _ in texts[-1])))
    first = {}
    for pieces in texts:
        for _, text, n, document in pieces:
            raw = text.tobytes()
            for k in range(n):
                key = raw[k : k + suffix.LENGTH]
                first[key] = min(first.get(key, document), document)
    expected = [
        [p + k for p, text, n, document in pieces for k in range(n) if first[text[k : k + suffix.LENGTH].tobytes()] < document] for pieces in texts
    ]
    for size in (1 << 14, 1 << 20):
        monkeypatch.setattr(suffix, "PASS_STARTS", size, raising=False)
        tracemalloc.start()
        found = suffix.merge_pieces(blobs)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x.tolist() for x in found] == expected and any(expected)
        assert size > 1 << 14 or peak < 30 * 800_160
