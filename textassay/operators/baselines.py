"""Two label-only baselines, drawn without a model.

Input is a split frame: ``seed, side, label`` and a row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def train_priors(split: DataFrame, label: str = "label") -> DataFrame:
    """Training rows per label and seed: one row per (seed, class)."""
    return split.filter("side = 'train'").groupBy("seed", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def majority(split: DataFrame, label: str = "label") -> DataFrame:
    """Test rows with the most frequent training label as prediction; ties go to the smaller label."""
    best = train_priors(split, label).groupBy("seed").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("prediction")
    )
    # One row per seed.
    return split.filter("side = 'test'").join(F.broadcast(best), "seed")


def uniform(row_id: str, seed: str, stream: str) -> Column:
    """A number in [0, 1) from the md5 of row, seed and stream name."""
    hexed = F.substring(F.md5(F.concat_ws(":", row_id, seed, F.lit(stream)).cast("binary")), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint").cast("double") / float(1 << 32)


def stratified(split: DataFrame, label: str = "label", row_id: str = "doc_id", stream: str = "dummy") -> DataFrame:
    """Test rows with a label drawn by the training shares."""
    upto = Window.partitionBy("seed").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    shares = train_priors(split, label).withColumn(
        "upto", F.sum("n").over(upto).cast("double") / F.sum("n").over(Window.partitionBy("seed")).cast("double")
    )
    # One row per seed, one entry per class.
    ladder = shares.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("_ladder"))
    drawn = split.filter("side = 'test'").withColumn("_u", uniform(row_id, "seed", stream)).join(F.broadcast(ladder), "seed")
    reached = F.filter("_ladder", lambda step: step["upto"] > F.col("_u"))
    return drawn.withColumn("prediction", F.get(reached, F.lit(0))["label"]).drop("_u", "_ladder")
