"""Registered queries over the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from textassay.llm import (
    alignment, bpe, centroids, html_text, licenses, phrases, quality, search, simhash, suffix, token_files, urls, warc,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# Allow and block entries (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in 10-word windows of the benchmark, and from which items."""
    found = phrases.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that an earlier document holds in strings of 50, and what is left."""
    return suffix.deduplicate(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    judged = urls.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.judge(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    index = warc.write_archives(table(spark, folder, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return bpe.digests(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files."""
    return token_files.read_ids(token_files.write_ids(table(spark, folder, "documents"), TOKENIZER))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses named in every document."""
    return licenses.licenses(table(spark, folder, "documents"))


def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all other vectors."""
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return alignment.align_tokenizers(table(spark, folder, "documents"), TOKENIZER, PIECES)


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster and squared distance of every vector after three rounds."""
    return centroids.report(*centroids.cluster(table(spark, folder, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_main_text": op5_main_text,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_licenses": op10_licenses,
    "op11_top_k": op11_top_k,
    "op12_alignment": op12_alignment,
    "op13_centroids": op13_centroids,
}

_RULE_ROWS = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FINITE = "embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding]), true)"
_WHOLE = "[CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding]"


def _assigned(rounds: int) -> str:
    """CTEs a0, c1, a1, ...: nearest centroid of every vector, and the centroids that follow from it."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""
        a{k} AS (
            SELECT vec_id, v, cluster, distance FROM (
                SELECT vec_id, kept.v, cluster, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS place
                FROM kept, c{k} AS c, LATERAL (SELECT CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(kept.v, c.v)]) AS BIGINT) AS distance)
            ) WHERE place = 1
        )""")
        if k < rounds:
            parts.append(f"""
        c{k + 1} AS (
            SELECT cluster, coalesce(moved.v, c.v) AS v FROM c{k} AS c LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM (
                    SELECT cluster, d, CAST(sum(v[d]) AS BIGINT) AS s, count(*) AS n FROM a{k}, unnest(range(1, 65)) AS t(d) GROUP BY cluster, d
                ) GROUP BY cluster
            ) AS moved USING (cluster)
        )""")
    return ",".join(parts)


ORACLE: dict[str, str] = {
    "op11_top_k": f"""
        WITH kept AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
        pairs AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, x.v)]) AS BIGINT) AS score
            FROM kept AS q JOIN kept AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_centroids": f"""
        WITH kept AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
        c0 AS (
            SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v
            FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16)
        ),{_assigned(3)},
        sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia,
               (SELECT CAST(sum(distance) AS BIGINT) FROM a3) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
        FROM a3 JOIN c3 USING (cluster) JOIN sums USING (cluster)
    """,
    "op1_decontamination": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS phrase
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
        ),
        places AS (
            SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
            FROM docs, (SELECT DISTINCT n FROM windows) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(s)
        ),
        hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, phrase)),
        counts AS (
            SELECT doc_id, count(DISTINCT s + k) AS n_hit
            FROM (SELECT DISTINCT doc_id, s, n FROM hits) AS h, unnest(range(0, n)) AS t(k) GROUP BY doc_id
        ),
        lists AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS h GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(item_list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN lists USING (doc_id)
    """,
    "op4_url_filter": f"""
        WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
        rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
            FROM rest
        ),
        fitting AS (
            SELECT p.page_id, r.verdict, r.host || r.path AS rule,
                   row_number() OVER (PARTITION BY p.page_id
                       ORDER BY length(r.host) DESC, length(r.path) DESC, r.verdict DESC) AS place
            FROM parts p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fitting f ON f.page_id = p.page_id AND f.place = 1
    """,
}
