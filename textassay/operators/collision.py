"""Token collisions: which tokens repair removes, and which it only thins out.

One scan builds the tokens of both text variants; only the suspect tokens of a
row leave it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions.numbers import residual_ratio, share, verdict
from textassay.functions.text import tokens

# The suspects and the size from which a collision is profiled.
SUSPECTS = (
    "39", "36", "151", "146", "147", "148", "160", "133", "145",
    "149", "38", "37", "lt", "gt", "amp", "quot", "nbsp", "apos",
)
PROFILE_MIN_DF = 2000


def suspect_hits(df: DataFrame, keep: list[str], suspects=SUSPECTS, dirty: str = "text",
                 repaired: str = "repaired") -> DataFrame:
    """One row per (row, suspect, case) in which either variant has the suspect."""
    wanted = F.array(*[F.lit(token) for token in suspects])
    rows = []
    for case_sensitive in (True, False):
        had = F.array_intersect(tokens(F.col(dirty), lowercase=not case_sensitive), wanted)
        still = F.array_intersect(tokens(F.col(repaired), lowercase=not case_sensitive), wanted)
        rows.append(F.struct(F.lit(case_sensitive).alias("case_sensitive"), had.alias("had"), still.alias("still")))
    wide = df.select(*keep, F.inline(F.array(*rows)))
    wide = wide.filter((F.size("had") > 0) | (F.size("still") > 0))
    token = F.explode(F.array_union("had", "still")).alias("token")
    return wide.select(*keep, "case_sensitive", "had", "still", token).select(
        *keep, "case_sensitive", "token",
        F.array_contains("had", F.col("token")).alias("had"),
        F.array_contains("still", F.col("token")).alias("still"),
    )


def collision_table(df: DataFrame, suspects=SUSPECTS, dirty: str = "text", repaired: str = "repaired") -> DataFrame:
    """Document frequency before and after repair for every suspect and case setting."""
    counts = suspect_hits(df, [], suspects, dirty, repaired).groupBy("token", "case_sensitive").agg(
        F.count_if("had").alias("dirty_df"), F.count_if("still").alias("residual")
    )
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in suspects])).alias("token")
    ).withColumn("case_sensitive", F.explode(F.array(F.lit(True), F.lit(False))))
    zero = F.lit(0).cast("bigint")
    table = grid.join(counts, ["token", "case_sensitive"], "left").withColumns({
        "dirty_df": F.coalesce("dirty_df", zero), "residual": F.coalesce("residual", zero),
    })
    d, r = F.col("dirty_df"), F.col("residual")
    return table.withColumns({"ratio": residual_ratio(d, r), "verdict": verdict(d, r)})


def case_differences(table: DataFrame) -> DataFrame:
    """Tokens whose residual depends on the case setting."""
    return (
        table.groupBy("token").pivot("case_sensitive", [True, False]).agg(F.first("residual"))
        .withColumnsRenamed({"true": "residual_cased", "false": "residual_uncased"})
        .filter(F.col("residual_cased") != F.col("residual_uncased"))
    )


def worth_profiling(table: DataFrame, min_df: int = PROFILE_MIN_DF) -> DataFrame:
    """Collisions frequent enough to profile, with the case setting that showed them."""
    return table.filter((F.col("verdict") == "collision") & (F.col("dirty_df") >= min_df)).select(
        "token", "case_sensitive"
    )


def class_profiles(df: DataFrame, suspects=SUSPECTS, column: str = "class_name", dirty: str = "text",
                   repaired: str = "repaired") -> DataFrame:
    """Class shares of the sense repair removes and of the sense that stays.

    A class without rows in one sense has share 0 there; a sense without any rows
    has a null share.
    """
    counts = suspect_hits(df, [column], suspects, dirty, repaired).groupBy("token", "case_sensitive", column).agg(
        F.count_if(F.col("had") & ~F.col("still")).alias("n_corrupted"),
        F.count_if("still").alias("n_genuine"),
    )
    per_token = Window.partitionBy("token", "case_sensitive")
    lost, kept = F.sum("n_corrupted").over(per_token), F.sum("n_genuine").over(per_token)
    return counts.withColumns({
        "corrupted_share": share(F.col("n_corrupted"), lost),
        "genuine_share": share(F.col("n_genuine"), kept),
        "corrupted_per_genuine": lost / F.greatest(kept, F.lit(1)),
    })
