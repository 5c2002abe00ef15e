"""URL filters, page text, WARC, BPE, id files, licenses and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm import odd
from llm.test_text_operators import brute_components, brute_fingerprint, brute_hits, brute_removed
from textassay.llm import bpe, html_text, licenses, queries, token_files, urls, warc

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12?q=/es/", "http://x.com/fr/a",
    "http://x.com/de/", "ftp://y.net/a#b", "http://org", "http://org/", "http://badexample.org/es/", "http://com?x=/fr/", "a://b://c/d",
]


def brute_verdict(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fitting = [(len(h), len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fitting, default=None)
    return host, path, best and best[4], best[3] if best else default


@pytest.mark.parametrize("default", ["allow", "block"])
def test_url_filter(spark, default):
    rules = [*queries.URL_RULES, ("block", "org", "/"), ("block", "y.net", ""), ("allow", "y.net", "/a/b"), ("allow", "x.com", "/f")]
    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string, _judged string")
    found = urls.filter_urls(pages, rules, default=default).collect()
    assert {r._judged for r in found} == {"z"}
    assert [(r.host, r.path, r.rule, r.verdict) for r in sorted(found)] == [brute_verdict(u, rules, default) for u in URLS + URLS]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_are_checked():
    with pytest.raises(ValueError):
        urls.Trie([("maybe", "org", "/")])


PAGES = [
    (0, "http://h.org/q/1", "<nav>Menu</nav><article><h1>T &amp; t</h1><p>One\n two<br>three</p><p></p></article><footer>f</footer>"),
    (1, "http://h.org/a/2", "<p>Site</p><p>own line one</p><p>Legal</p>"),
    (2, "http://h.org/a/3", "<p>Site</p><p>another line</p><p>Legal</p>"),
    (3, "http://lone.org/", "<p>Site</p><div class='cookie notice'>no<div>no</div></div><p>x</p>"),
    (4, None, None), (5, "", ""), (6, "http://other.org/a/2", "<p>Site</p>"), (7, "x", "<script>var a='</p>'</script>a<p>" + "long " * 50_000),
    (None, "http://n.org/", "plain &lt; text<!-- no -->"), (8, "http://h.org/z", "<article class=post><div class=comments><p>no</p></div><p>yes</p></article>"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, row long, host long")
    found = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert len(found) == len(PAGES)
    expected = {
        0: "T & t\nOne two three", 1: "own line one", 2: "another line", 3: "Site\nx", 4: "", 5: "", 6: "Site", 7: "a\n" + "long " * 49_999 + "long",
        None: "plain < text", 8: "yes",
    }
    assert {k: r.text for k, r in found.items()} == expected
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_copies_do_not_count_as_furniture(spark):
    body = [f"<p>line {k} of the text</p>" for k in range(12)]
    frame = lambda x: f"<p>Site</p><p>Menu</p>{x}<p>Legal</p>"
    other = "".join(f"<p>other {k}</p>" for k in range(9))
    pages = [
        (1, "http://mirror.org/a", "".join(body)), (2, "http://mirror.org/b", "".join(body)), (3, "http://mirror.org/b?x=1", "".join(body)),
        (4, "http://near.org/a", "".join(body)), (5, "http://near.org/b", "".join(["<p>changed</p>", *body[1:]])),
        (6, "http://framed.org/a", frame("".join(body))), (7, "http://framed.org/a/copy", frame("".join(body))),
        (8, "http://framed.org/b", frame(other)), (8, "http://framed.org/b", frame(other)),
        (9, "http://framed.org/c", ""),
    ]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, near string")
    found = html_text.main_text(rows).collect()
    plain = [f"line {k} of the text" for k in range(12)]
    expected = {
        1: plain, 2: plain, 3: plain, 4: plain, 5: ["changed", *plain[1:]], 6: plain, 7: plain, 8: [f"other {k}" for k in range(9)], 9: [],
    }
    assert len(found) == len(pages)
    assert all(r.text == "\n".join(expected[r.page_id]) for r in found)


def test_marked_pages_are_differenced_too(spark):
    page = lambda inside, after="", before="": f"{before}<article>{inside}</article>{after}"
    texts = ["".join(f"<p>text {k} {n}</p>" for n in range(5)) for k in range(8)]
    pages = [
        (1, "http://a.org/1", page("<p>Slogan</p><p>Results</p>" + texts[1], "<p>own advert</p>")),
        (2, "http://a.org/2", page("<p>Results</p>" + texts[2], before="<p>Slogan</p>")),
        (3, "http://b.org/1", page("<p>Slogan</p>" + texts[3])), (4, "http://b.org/2", "<p>Slogan</p>" + texts[4]),
        (5, "http://c.org/1", page("<p>Slogan</p>" + texts[5], "<p>Legal</p>")),
        (6, "http://d.org/1", page("<p>Results</p>" + texts[6])), (7, "http://d.org/2", page("<p>Results</p>" + texts[7])),
    ]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    first = {1: ["Results"], 2: ["Results"], 5: ["Slogan"], 6: ["Results"], 7: ["Results"]}
    assert found == {k: "\n".join([*first.get(k, []), *(f"text {k} {n}" for n in range(5))]) for k in range(1, 8)}


def test_main_text_of_all_small_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    for row in rows.collect():
        article = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert found[row.page_id] == "\n".join(x for x in blocks if x)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    shared = html_text.shared_lines(np.array(a, np.uint64), np.array(b, np.uint64))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert shared.sum() == table[-1, -1]
    rest = iter(b)
    assert all(x in rest for x, s in zip(a, shared) if s)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    rows = [(5, "http://a/\r\n1", "same é"), (3, None, "same é"), (9, "http://b", "same é"), (1, "u", "x" * 200_000), (2, "u", ""), (4, "u", None),
            (None, "u", "same é"), (7, "u", "other")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    index = warc.write_archives(pages, min_bytes=least)
    found = {r.page_id: r for r in warc.read_records(index).collect()}
    first = {}
    for page_id, _, text in rows:
        if page_id is not None and len((text or "").encode()) >= least:
            first[text or ""] = min(page_id, first.get(text or "", page_id))
    for page_id, url, text in rows:
        data, row = (text or "").encode(), found[page_id]
        refers = first.get(text or "")
        refers = refers if page_id is not None and refers not in (None, page_id) else None
        assert row.payload_bytes == len(data) and row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (row.record_type, row.refers_to) == ("response" if refers is None else "revisit", refers)
        assert row.payload == (data if refers is None else None)
        assert row.url == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))
    some = warc.read_records(index.filter("page_id in (1, 9)")).collect()
    assert {r.page_id for r in some} == {1, 9}
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_keeps_odd_and_repeated_ids(spark):
    ids = ["a\r\nX-Page-ID: b", "50%41", "é ü", "", "twice", "twice", None]
    pages = spark.createDataFrame([(x, "u", f"page {k}") for k, x in enumerate(ids)], "page_id string, url string, html string")
    found = warc.read_records(warc.write_archives(pages)).collect()
    assert sorted((r.page_id or "none", r.payload.decode()) for r in found) == sorted((x or "none", f"page {k}") for k, x in enumerate(ids))
    same = spark.createDataFrame([("b\n", "u", "same"), ("a\n", "u", "same"), ("a\n", "v", "same")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.refers_to) for r in warc.read_records(warc.write_archives(same)).collect()) == [
        ("a\n", None), ("a\n", None), ("b\n", "a\n"),
    ]


def test_warc_index_points_at_gzip_members(spark):
    pages = spark.createDataFrame([(k, f"http://p/{k}", f"page {k % 3}") for k in range(9)], "page_id long, url string, html string")
    for row in warc.write_archives(pages).collect():
        with open(row.file.removeprefix("file:"), "rb") as source:
            source.seek(row.offset)
            fields, _, _ = warc.parse(source.read(row.length))
        assert fields["WARC-Target-URI"] == row.url == f"http://p/{row.page_id}" and fields["WARC-Type"] == row.record_type


TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
ENCODER = bpe.TextEncoder(queries.RANKS, public_tokenizers.PATTERN)


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(max_size=60), st.text("aeinorst 'é\n", max_size=80), st.lists(st.sampled_from(list(bpe.read_ranks(queries.RANKS))), max_size=8).map(
    lambda x: b"".join(x).decode(errors="ignore"))))
def test_bpe_equals_the_library(text):
    ids = ENCODER.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


def test_bpe_rows(spark):
    docs = odd.documents(spark)
    expected = {None if k == 2 else k: TIKTOKEN.encode_ordinary(t or "") for k, t in enumerate(odd.TEXTS)}
    coded = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in coded.collect()} == expected
    content = odd.by_id(bpe.decode(coded, queries.RANKS))
    for row in bpe.digests(docs, queries.RANKS, public_tokenizers.PATTERN).collect():
        ids, text = expected[row.doc_id], (odd.TEXTS[2 if row.doc_id is None else row.doc_id] or "").encode()
        assert bytes(content[row.doc_id].content) == text
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text).hexdigest()
    assert bpe.digests(odd.empty(spark), queries.RANKS, public_tokenizers.PATTERN).count() == 0


TOKENIZER = Tokenizer.from_file(queries.TOKENIZER)
TOKENS = token_files.Tokens(queries.TOKENIZER)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab 's\n\t\x1c\xa0é<|>", max_size=40)), max_size=4))
def test_cut_texts_have_the_library_s_ids(texts):
    expected = [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, TOKENS.kind).tolist() for x in TOKENS.encode(texts)] == expected


def test_added_tokens_have_the_library_s_ids():
    library = Tokenizer.from_file(queries.TOKENIZER)
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"a{end}b c d", f"{end} {end}", end, f"no end of text <|endoftext| >\nand {end}\n", "a <|endoftext b"]
    tokens = token_files.Tokens(queries.TOKENIZER)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, tokens.kind).tolist() for x in tokens.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_id_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2_000)
    ids = [None if k == 2 else (k * 7) % 19 - 3 for k in range(len(odd.TEXTS))]
    files = token_files.write_ids(odd.documents(spark, odd.TEXTS, ids), queries.TOKENIZER)
    found = sorted(token_files.read_ids(files).collect(), key=lambda r: r.start)
    total = 0
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    for row, k in zip(found, order, strict=True):
        own = [*TOKENIZER.encode(odd.TEXTS[k] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (row.doc_id, row.start, row.n_tokens) == (ids[k], total, len(own))
        assert row.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        total += len(own)
    one = files.orderBy("part", "piece").first()
    reader = token_files.Reader(one.file, one.dictionary)
    assert reader.document(0)[-1] == token_files.END_ID
    assert token_files.read_ids(token_files.write_ids(odd.empty(spark), queries.TOKENIZER)).count() == 0
    with pytest.raises(TypeError):
        token_files.write_ids(odd.documents(spark).withColumn("doc_id", F.col("text")), queries.TOKENIZER)


def test_licenses(spark):
    mit, apache, gpl = (licenses.TEMPLATES[k].text for k in (1, 2, 4))
    changed = mit.replace("hereby ", "").replace("modify,", "modify and").replace("sell", "vend")
    texts = odd.TEXTS + [
        apache, f"{gpl}\n{gpl}", f"before {changed} after", f"{odd.LINE}\n{apache}\n{odd.LINE}\n{gpl}", "Released under the BSD License.",
        "licensed under the terms of the seller", " ".join(mit.split()[::2]),
    ]
    found = odd.by_id(licenses.licenses(odd.documents(spark, texts)))
    base = len(odd.TEXTS)
    assert all(not found[None if k == 2 else k].n_notices for k in range(base))
    assert found[base].license == "apache-2.0" and found[base].coverage == 1.0
    assert (found[base + 1].licenses, found[base + 1].n_notices) == (["gpl-3.0"], 2)
    assert found[base + 2].license == "mit" and 0.9 < found[base + 2].coverage < 1
    assert found[base + 3].licenses == ["apache-2.0", "gpl-3.0"]
    assert [found[base + k].n_notices for k in (4, 5, 6)] == [0, 0, 0]
    assert licenses.licenses(odd.empty(spark)).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 8), max_size=20), st.lists(st.integers(0, 8), max_size=20))
def test_patience_pairs_are_equal_and_ascending(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(licenses.patience(a, a)) == len(a)


def common_length(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@settings(deadline=None, max_examples=150)
@given(st.permutations(range(8)), st.lists(st.integers(10, 12), max_size=6), st.integers(0, 8), st.lists(st.integers(0, 4), max_size=12))
def test_coverage_equals_longest_common_subsequence(order, foreign, at, loose):
    template = list(range(8))
    text = [*order[:at], *foreign, *order[at:]]
    assert len(licenses.patience(text, template)) == common_length(text, template)
    assert len(licenses.patience(loose, template)) <= common_length(loose, template)


def test_related_licenses_are_told_apart(spark):
    every = licenses.TEMPLATES
    texts = ["\n".join([x.text] * n) for x in every for n in (1, 3)]
    found = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, template in enumerate(every):
        for row, n in ((found[2 * k], 1), (found[2 * k + 1], 3)):
            assert (row.licenses, row.n_notices, row.coverage) == ([template.license], n, 1.0), template.text
    others = {
        "Not released under the MIT License.": [], "This was never released under the MIT License.": [],
        "under the GNU Affero General Public License, version 3, which": ["agpl-3.0"], "licensed under the GNU Lesser General Public License, version 3": ["lgpl-3.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa-4.0"], "Licensed under CC BY-SA 3.0.": ["cc-by-sa-3.0"], None: [], "": [],
        "MIT License " + every[1].text.replace("free of charge, ", ""): ["mit"],
        " ".join(f"w{k}" for k in range(30_000)) + " Released under the MIT License.": ["mit"],
    }
    rows = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    found = {r.doc_id: r.licenses for r in licenses.licenses(rows).collect()}
    assert [found[k] for k in range(len(others))] == list(others.values())


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("extra", F.lit("x"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        steps[name] = (sorted(docs.collect()), sorted(out.collect()))
        docs = spark.createDataFrame(steps[name][1], docs.schema)
    before, after = steps["quality"]
    assert 0 < len(after) < len(before)
    before, after = steps["near_duplicates"]
    groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in before])
    assert [r.doc_id for r in after] == [r.doc_id for r in before if groups[brute_fingerprint(r.text)] == r.doc_id]
    before, after = steps["suffix_dedup"]
    left = {d: text for d, *_, text in brute_removed([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == left and all(r.n_chars == len(r.text) for r in after)
    before, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute_hits([(r.doc_id, r.text) for r in before], items)
    assert [r.doc_id for r in after] == [r.doc_id for r in before if not hit[r.doc_id][3]]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id: r.n_tokens for r in last.collect()} == {r.doc_id: len(TIKTOKEN.encode_ordinary(r.text or "")) for r in after}


def test_pipeline_takes_odd_rows(spark):
    docs = odd.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("read", [True, False])
def test_pipeline_keeps_clean_rows_with_null_and_repeated_ids(spark, tmp_path, read):
    folder = "/root/testdata/sf0.001"
    quoted = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    clean = [" ".join(f"{w}{k}" for w in "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch".split()) for k in "qrstuv"]
    rows = [(1, clean[0]), (None, clean[1]), (None, clean[2]), (2, clean[3]), (2, clean[4]), (3, clean[5])]
    bad = {"quality": [(None, "short"), (2, "short")], "near_duplicates": [(None, clean[0]), (2, clean[0])], "decontamination": [(None, quoted), (2, quoted)]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name not in bad:
            continue
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + bad[name]], "doc_id long, text string, lang string, source string, n_chars long")
        if read:
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert corpus_pipeline._is_scan(docs) == read
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert sorted((r.text, r.doc_id or 0) for r in out.collect()) == sorted((t, i or 0) for i, t in rows), name
