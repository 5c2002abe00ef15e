"""Append-safe JSON-lines results log, shared by several experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "experiment STRING, cell STRING, train STRING, test STRING, seed INT, n INT, macro_f1 DOUBLE, "
    "vocab_size INT, test_idx_sha1 STRING, fit_seconds DOUBLE, git_sha STRING, git_dirty BOOLEAN, "
    "sklearn STRING, engine_version STRING, run_id STRING, code_sha STRING, code_dirty BOOLEAN"
)


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records; fields a record lacks are null, blank lines are skipped."""
    return spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST").json(path)


def read_cells(spark: SparkSession, path: str | list[str], experiment: str, field: str = "macro_f1") -> DataFrame:
    """Long ``seed, cell, value`` of one experiment and one field.

    Fails when the experiment has no rows, when a record lacks the field, and when
    a (seed, cell) occurs twice: lines have no order here, so no last one wins.
    """
    rows = read_results(spark, path).filter(F.col("experiment") == experiment)
    cells = rows.select("seed", "cell", F.col(field).alias("value"))
    state = cells.groupBy("seed", "cell").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("lacking")
    ).agg(
        F.count("*").alias("keys"),
        F.min(F.when(F.col("lacking") > 0, F.struct("seed", "cell"))).alias("lacking"),
        F.min(F.when(F.col("n") > 1, F.struct("seed", "cell"))).alias("twice"),
    ).first()
    if state["keys"] == 0:
        raise LookupError(f"no rows with experiment={experiment!r} in {path}")
    if state["lacking"] is not None:
        raise KeyError(f"record for seed {state['lacking'].seed} has no {field!r}")
    if state["twice"] is not None:
        raise ValueError(f"seed {state['twice'].seed}, cell {state['twice'].cell} occurs more than once")
    return cells


def with_provenance(df: DataFrame, run_id: str, code_sha: str = "unknown", code_dirty: bool | None = None) -> DataFrame:
    """Stamp every row with engine version, run and code revision."""
    return df.withColumns({
        "engine_version": F.lit(df.sparkSession.version),
        "run_id": F.lit(run_id),
        "code_sha": F.lit(code_sha),
        "code_dirty": F.lit(code_dirty).cast("boolean"),
    })


def union_results(*frames: DataFrame) -> DataFrame:
    """Records of several experiments; a column one of them lacks becomes null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def write_results(df: DataFrame, path: str) -> None:
    """Write records; an existing path is an error, never overwritten."""
    df.write.mode("errorifexists").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each record as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
