"""Exact search, tokenizer alignment and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import odd
from textassay.llm import alignment, centroids, queries, search

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="array<float>"):
    """A table of vectors with columns whose names operators use inside."""
    clash = ("v", "query", "shard", "cluster", "distance", "rank", "place", "n")
    schema = f"vec_id long, embedding {kind}" + "".join(f", `{x}` string" for x in clash)
    return spark.createDataFrame([(*row, *("clash",) * len(clash)) for row in rows], schema)


def drawn(n, width, seed, copies=0):
    values = np.random.default_rng(seed).normal(0, 0.3, (n, width)).astype(np.float32).tolist()
    return values + [values[0]] * copies


def whole(vector, width):
    return [int(np.floor(64 * float(np.float32(x)))) for x in vector] + [0] * (width - len(vector))


def good(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


# Exact search


def brute_top(rows, k, width):
    kept = [(i, whole(v, width)) for i, v in rows if good(v)]
    out = []
    for at, (query_id, q) in enumerate(kept):
        if query_id is None or query_id % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), i is None, i or 0, i) for other, (i, x) in enumerate(kept) if other != at]
        out += [(query_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("shard", "leaf", "file", "block"), [(8192, 256, 256, 1024), (32, 4, 2, 3), (7, 1, 1, 2)])
def test_top_k(spark, monkeypatch, shard, leaf, file, block):
    for name, value in (("SHARD_ROWS", shard), ("LEAF_ROWS", leaf), ("FILE_SHARDS", file), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(search, name, value)
    values = drawn(150, 6, 1, copies=40) + [None, [1.0, None] * 3, [NAN] * 6, [INF] + [0.0] * 5, [0.5] * 3, [], [-1.0] * 6]
    rows = [(k, v) for k, v in enumerate(values)] + [(10, values[3]), (10, values[3]), (None, values[4])]
    found = search.top_k(vectors(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, k=4)
    assert Counter(tuple(r) for r in found.collect()) == brute_top(rows, 4, 6)


def test_top_k_of_few_rows(spark):
    df = vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (5, [0.0, -1.0])])
    found = search.top_k(df, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 64 * 64 * 11), (0, 2, 5, -2 * 64 * 64), (5, 1, 0, -2 * 64 * 64), (5, 2, 1, -4 * 64 * 64)]
    assert search.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert search.top_k(df, F.col("vec_id") < 0).count() == 0
    assert search.top_k(df.limit(1), F.lit(True)).count() == 0


def test_products_are_exact():
    a = np.array([[1 << 29, -(1 << 29) + 1]])
    assert search.products(a, a)[0, 0] == (1 << 58) + ((1 << 29) - 1) ** 2
    with pytest.raises(OverflowError):
        search.products(a * 16, a)


def test_traversal_opens_few_leaves():
    """Far clusters: most boxes are ruled out by the k-th result."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-5, 6, (256, 8)) + 100 * c for c in range(16)])
    tree = search.Tree(x, np.arange(len(x)), np.zeros(len(x), bool))
    opened, plain = [], search.Found.take
    found = search.Found(1, 5)
    found.take = lambda rows, score, ids: opened.append(score.shape) or plain(found, rows, score, ids)
    search.traverse(tree, np.full((1, 8), 10), found)
    assert len(opened) <= 2 and len(tree.nodes) > 30
    assert found.score[0].tolist() == sorted((x @ np.full(8, 10)).tolist(), reverse=True)[:5]


# Centroid clustering


def brute_nearest(x, c):
    gap = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return gap.argmin(axis=1), gap.min(axis=1)


def brute_clusters(rows, width, k, rounds):
    kept = [(i, whole(v, width)) for i, v in rows if good(v) and len(v) == width]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c, x = np.array([v for _, v in order[:k]]), np.array([v for _, v in kept])
    for _ in range(rounds):
        own, _ = brute_nearest(x, c)
        c = np.array([[sum(col) // len(col) for col in x[own == j].T.tolist()] if (own == j).any() else c[j].tolist() for j in range(len(c))])
    own, distance = brute_nearest(x, c)
    sha = [hashlib.sha256(",".join(map(str, j.tolist())).encode()).hexdigest() for j in c]
    inertia = [int(distance[own == j].sum()) for j in range(len(c))]
    return Counter((i, int(o), int(d), inertia[o], sum(inertia), sha[o]) for (i, _), o, d in zip(kept, own, distance))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 9), st.integers(1, 30))
def test_threshold_walk_finds_the_nearest(seed, width, k, n):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-4, 5, (n, width)), rng.integers(-4, 5, (k, width))  # many ties
    found = centroids.nearest(x, c)
    assert [a.tolist() for a in found] == [a.tolist() for a in brute_nearest(x, c)]


@pytest.mark.parametrize("size", [3, 2048])
def test_clusters(spark, monkeypatch, size):
    monkeypatch.setattr(centroids, "SLICE_ROWS", size)
    values = drawn(70, 4, 2, copies=30) + [None, [1.0, None, 1.0, 1.0], [NAN] * 4, [-INF] * 4, [1.0] * 3, [], [1.0] * 5, [0.0] * 4, [0.0] * 4]
    rows = [(k, v) for k, v in enumerate(values)] + [(7, values[1]), (7, values[1]), (None, values[2])]
    found = centroids.report(*centroids.cluster(vectors(spark, rows).repartition(3), clusters=5, width=4))
    assert Counter(tuple(r) for r in found.collect()) == brute_clusters(rows, 4, 5, 3)


def test_clusters_of_few_rows(spark):
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)])
    assert Counter(tuple(r)[:5] for r in centroids.report(*centroids.cluster(df, width=2)).collect()) == {(1, 0, 0, 0, 0): 1, (2, 0, 0, 0, 0): 1}
    assert centroids.report(*centroids.cluster(df.limit(0), width=2)).count() == 0
    assert centroids.report(*centroids.cluster(df.filter("vec_id = 3"), width=2)).count() == 0
    with pytest.raises(Exception, match="in magnitude"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), width=2)


# Alignment


def brute_align(texts):
    """Rows of the alignment by a plain merge of both lists of ends."""
    a_tok = Tokenizer.from_file(queries.TOKENIZER)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = alignment.byte_letters()
    out, held = [], []
    for text in texts:
        a, b, groups = [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
                a, b = [], []
            else:
                a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                common = sorted(set(a_end) & set(b_end))
                i = j = 0
                for end in common:
                    x, y = a_end.index(end, i) + 1, b_end.index(end, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        pairs = Counter()
        for left, right in groups:
            counts = Counter(right)
            for p, m in Counter(left).items():
                for q, n in counts.items():
                    pairs[p, q] += m * n
        held.append(pairs)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([len(a), len(b), len(groups), sum(pairs.values()), hashlib.sha256(line.encode()).hexdigest() if groups else ""])
    total = Counter(pair for pairs in held for pair in pairs)
    best = Counter()
    for (p, _), n in total.items():
        best[p] = max(best[p], n)
    for row, pairs in zip(out, held):
        row[4:4] = [sum(n for pair, n in pairs.items() if total[pair] == best[pair[0]]), sum(n * total[pair] for pair, n in pairs.items())]
    return [tuple(row) for row in out]


ODD_TEXTS = [
    *odd.TEXTS, "a <|endoftext|> b", "<s> </s> <unk> <0x0A>", "with ▁ inside", "nul\0here", " lead", "trail ", " nbsp   x", "\r\n\r\n",
    "a\nb c\n d", "=" * 5_000, " " * 3_000, "Ünïcödé straße " * 20, "x" + " " * 40 + "y", "﻿bom", "é accent", "\U0010ffff last",
]


@pytest.mark.parametrize(("size", "lane", "table"), [(2 << 20, 256, 4_000_000), (64, 2, 50)])
def test_alignment(spark, monkeypatch, size, lane, table):
    monkeypatch.setattr(alignment, "SLICE_BYTES", size)
    monkeypatch.setattr(alignment.align, "__defaults__", (lane,))
    for name in ("TABLE_PAIRS", "LOOKUP_PAIRS"):
        monkeypatch.setattr(alignment, name, table)
    monkeypatch.setattr(alignment, "_TABLE", {})
    ids = [None if k == 2 else 3 if k in (4, 5) else 100 + k for k in range(len(ODD_TEXTS))]
    found = alignment.align_tokenizers(odd.documents(spark, ODD_TEXTS, ids).repartition(3), queries.TOKENIZER, queries.PIECES)
    expected = Counter(zip(ids, brute_align(ODD_TEXTS)))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter((r.doc_id, tuple(r[x] for x in names)) for r in found.collect()) == expected
    assert alignment.align_tokenizers(odd.empty(spark), queries.TOKENIZER, queries.PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(1, 9))
def test_run_skipping_finds_all_common_ends(a, b, lane):
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    last = max(a_end[-1], b_end[-1]) + 1
    a_end, b_end = np.append(a_end, last), np.append(b_end, last)
    a_last, b_last = alignment.align(a_end, b_end, lane)
    assert a_end[a_last].tolist() == b_end[b_last].tolist() == sorted(set(a_end.tolist()) & set(b_end.tolist()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab. \n\té日1'"), max_size=30), min_size=1, max_size=5))
def test_cut_texts_have_both_libraries_ids(texts):
    with open(queries.TOKENIZER, "rb") as a, open(queries.PIECES, "rb") as b:
        tokens = alignment._loaded(a.read(), b.read())
    for text, (a, b) in zip(texts, tokens.encode(texts)):
        if text:
            assert np.frombuffer(a, "<u4").tolist() == tokens.a.encode(" " + text, add_special_tokens=False).ids
            assert np.frombuffer(b, "<u4").tolist() == tokens.b.encode(text)


def test_files_are_public():
    assert queries.PIECES == public_tokenizers.path("piece_bpe_32k.model")
