"""A corpus pipeline: each stage takes the documents its predecessor kept.

Stages return the columns of ``documents``; the last returns the digests of the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.llm import bpe, phrases, quality, simhash, suffix
from textassay.llm.queries import RANKS
from textassay.session import broadcast_checked, settle


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is files as they are read, with columns chosen or added, and nothing else."""
    if "_metadata" in docs.columns or not hasattr(docs, "_jdf"):
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and len(docs.select("_metadata.row_index").columns) == 1


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and the name of that column.

    The key of a row read from a file is a digest of the file's path and the row's place in it; other rows
    are settled first, so that they keep the number they are given.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    try:
        scan = _is_scan(docs)
    except AnalysisException:  # files of a kind that does not number its rows
        scan = False
    if scan:
        file = F.base64(F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))))
        return docs.withColumn(name, F.concat_ws("#", "_metadata.row_index", file)), name
    return settle(docs.withColumn(name, F.monotonically_increasing_id().cast("string"))), name


def _without(keyed: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """``keyed`` without the rows whose key is the only column of ``gone``, and without the key."""
    gone = broadcast_checked(settle(gone.toDF(name)))
    return keyed.join(gone, name, "left_anti").drop(name)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers go, each row by its own text."""
    keyed, name = _keyed(docs)
    return _without(keyed, name, quality.judge(keyed, row_id=name).filter("not kept").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest doc_id.

    A null doc_id comes after all others. Among rows that repeat the id, a hash of the text decides,
    then the key of the row.
    """
    keyed, name = _keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(name).alias("key"))
    groups = simhash.near_duplicates(keyed.select(place.alias("place"), "text"), row_id="place")
    return _without(keyed, name, groups.filter("doc_id.key != component_id.key").select("doc_id.key"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what earlier documents hold in strings of 50 bytes; n_chars is that of the new text.

    All rows stay, those with nothing left too.
    """
    others = tuple(x for x in docs.columns if x not in ("doc_id", "text", "n_chars"))
    kept = suffix.deduplicate(docs, texts=True, carried=others)
    kind = docs.schema["n_chars"].dataType
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept"), "n_chars": F.char_length("kept").cast(kind)}
    return kept.select(*(new.get(x, F.col(f"carried.`{x}`")).alias(x) for x in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words inside a benchmark item's ten-word window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, name = _keyed(docs)
    return _without(keyed, name, phrases.contamination(keyed, benchmark, row_id=name).filter("contaminated").select("doc_id"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode_bpe),
]

# Most stages are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
