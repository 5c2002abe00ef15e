"""Exact, seeded, partition-independent samples and splits.

A row's place in the order of one seed is the md5 of ``id:seed``. Taking the
first n rows of that order does not need a global sort: a histogram over the
first hex digits finds the bucket of the n-th row, a rank inside that one bucket
finds the row itself, and a filter on its hash selects the rest without moving
any text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.session import broadcast_checked, settle

# The sample size, the seeds, the test share and the ladder.
N_SAMPLE = 5000
SEEDS = (0, 1, 2, 3, 4)
TEST_PERCENT = 20
LADDER = (4_000, 8_000, 16_000, 32_000, 64_000, 80_000)
LADDER_POOL = 96_000  # rows of the pool that the ladder was made for
REVIEW_ROWS = 100

BUCKET_DIGITS = 4  # 65,536 buckets per group

ID_BITS, FAN_BITS = 18, 15  # ids per leaf of a fingerprint, leaves per node


def place(row_id: str, seed: int | Column | str) -> Column:
    """Sort key of a row under a seed."""
    seed = F.col(seed) if isinstance(seed, str) else seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", F.col(row_id).cast("string"), seed.cast("string")).cast("binary"))


def smallest(df: DataFrame, n: int, seed: int, row_id: str = "doc_id") -> DataFrame:
    """The n rows that come first under the seed; for samples of report size."""
    return df.orderBy(place(row_id, seed), row_id).limit(n)


def _match(left: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"d.{g}").eqNullSafe(F.col(f"q.{g}")) for g in left], F.lit(True))


def cut_rows(df: DataFrame, quotas: DataFrame, groups: list[str], row_id: str, seed) -> DataFrame:
    """For each (group, cut) the hash and id of the row whose rank is ``quota``.

    ``quotas`` has the group columns, ``cut`` and ``quota`` (>= 1). The result has
    one row per (group, cut) and is settled.
    """
    keys = df.select(*groups, F.col(row_id).alias("_id"), place(row_id, seed).alias("_h"))
    keys = keys.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    running = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        keys.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
    )
    hit = (
        buckets.alias("d").join(quotas.alias("q"), _match(groups))
        .filter((F.col("quota") <= F.col("_upto")) & (F.col("quota") > F.col("_upto") - F.col("_n")))
        .select(*[F.col(f"d.{g}") for g in groups], "_b", "cut",
                (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    hit = settle(hit)
    inside = (
        keys.alias("d").join(broadcast_checked(hit).alias("q"), _match(groups + ["_b"]))
        .select(*[F.col(f"d.{g}") for g in groups], "d._b", "_h", "_id", "cut", "_need")
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "cut").orderBy("_h", "_id"))
    return settle(
        inside.withColumn("_r", rank).filter(F.col("_r") == F.col("_need"))
        .select(*groups, "cut", F.col("_h").alias("cut_h"), F.col("_id").alias("cut_id"))
    )


def within(h: Column, row_id: Column) -> Column:
    """Whether a row comes no later than the cut row."""
    return (h < F.col("cut_h")) | ((h == F.col("cut_h")) & (row_id <= F.col("cut_id")))


def sample_n(df: DataFrame, n: int, seed: int, row_id: str = "doc_id") -> DataFrame:
    """Exactly n rows without replacement; asking for more than there are is an error."""
    spark = df.sparkSession
    have = df.count()
    if n > have:
        raise ValueError(f"cannot take {n} rows from {have} without replacement")
    if n == have:
        return df
    quotas = spark.range(1).select(F.lit(0).alias("cut"), F.lit(n).cast("bigint").alias("quota"))
    cut = cut_rows(df, quotas, [], row_id, seed).drop("cut")
    # One row, by construction.
    return df.join(F.broadcast(cut)).filter(within(place(row_id, seed), F.col(row_id))).drop("cut_h", "cut_id")


def class_quotas(counts: DataFrame, label: str, groups: list[str], percent: int = TEST_PERCENT) -> DataFrame:
    """Test rows per class by largest remainder; they total ceil(percent of n).

    ``counts`` has one row per (group, class) with ``n``.
    """
    per_group = Window.partitionBy(*groups)
    ranked = per_group.orderBy(F.desc("_rest"), label)
    return (
        counts.withColumns({
            "_base": F.expr(f"n * {percent} div 100"),
            "_rest": (F.col("n") * percent) % 100,
            "_total": F.sum("n").over(per_group),
        })
        .withColumn("_extra", F.expr(f"(_total * {percent} + 99) div 100") - F.sum("_base").over(per_group))
        .withColumn("quota", F.col("_base") + (F.row_number().over(ranked) <= F.col("_extra")).cast("bigint"))
        .select(*groups, label, "n", "quota")
    )


def with_seeds(df: DataFrame, seeds=SEEDS) -> DataFrame:
    """Every row once per seed."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def stratified_split(df: DataFrame, label: str = "label", row_id: str = "doc_id", seeds=SEEDS,
                     percent: int = TEST_PERCENT) -> DataFrame:
    """Each row once per seed with ``side`` = train or test, stratified by label."""
    seeded = with_seeds(df, seeds)
    groups = ["seed", label]
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    quotas = class_quotas(with_seeds(counts, seeds), label, ["seed"], percent)
    quotas = quotas.filter("quota > 0").withColumn("cut", F.lit(0))
    cuts = cut_rows(seeded.select("seed", label, row_id), quotas, groups, row_id, "seed")
    joined = seeded.alias("d").join(broadcast_checked(cuts).alias("q"), _match(groups), "left")
    is_test = F.coalesce(within(place("d." + row_id, F.col("d.seed")), F.col("d." + row_id)), F.lit(False))
    return joined.select("d.*", F.when(is_test, "test").otherwise("train").alias("side"))


def split_samples(df: DataFrame, n: int, seeds=SEEDS, label: str = "label", row_id: str = "doc_id", percent: int = TEST_PERCENT) -> DataFrame:
    """A stratified split of n rows drawn without replacement, for all seeds at once: ``row_id, label, seed, side``.

    The same rows as ``sample_n`` followed by ``stratified_split`` for each seed.
    """
    have = df.count()
    if n > have:
        raise ValueError(f"cannot take {n} rows from {have} without replacement")
    drawn = with_seeds(df.select(row_id, label), seeds)
    if n < have:
        quotas = with_seeds(df.sparkSession.range(1).select(F.lit(0).alias("cut"), F.lit(n).cast("bigint").alias("quota")), seeds)
        cuts = cut_rows(drawn, quotas, ["seed"], row_id, "seed")
        # One row per seed.
        joined = drawn.alias("d").join(F.broadcast(cuts).alias("q"), _match(["seed"]))
        drawn = settle(joined.filter(within(place("d." + row_id, F.col("d.seed")), F.col("d." + row_id))).select("d.*"))
    counts = drawn.groupBy("seed", label).agg(F.count("*").alias("n"))
    quotas = class_quotas(counts, label, ["seed"], percent).filter("quota > 0").withColumn("cut", F.lit(0))
    cuts = cut_rows(drawn.select("seed", label, row_id), quotas, ["seed", label], row_id, "seed")
    joined = drawn.alias("d").join(broadcast_checked(cuts).alias("q"), _match(["seed", label]), "left")
    is_test = F.coalesce(within(place("d." + row_id, F.col("d.seed")), F.col("d." + row_id)), F.lit(False))
    return joined.select("d.*", F.when(is_test, "test").otherwise("train").alias("side"))


def nested_prefixes(df: DataFrame, ladder=LADDER, seeds=SEEDS, row_id: str = "doc_id") -> DataFrame:
    """Each row once per seed with the smallest ladder step that contains it.

    Prefixes of one shuffle per seed, so a step only adds rows to the one below.
    Rows beyond the last step have a null ``step``. A step larger than the pool is
    an error: every seed would train on the same rows.
    """
    have = df.count()
    if max(ladder) >= have:
        raise ValueError(f"ladder step {max(ladder)} exhausts the pool of {have} rows")
    spark = df.sparkSession
    seeded = with_seeds(df, seeds)
    steps = F.array(*[F.struct(F.lit(k).alias("cut"), F.lit(k).cast("bigint").alias("quota")) for k in ladder])
    quotas = with_seeds(spark.range(1).select(F.inline(steps)), seeds)
    cuts = cut_rows(seeded.select("seed", row_id), quotas, ["seed"], row_id, "seed")
    # One row per seed, each with at most one entry per step.
    by_seed = cuts.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("cut", "cut_h", "cut_id"))).alias("_cuts"))
    h, i = place(row_id, "seed"), F.col(row_id)
    inside = F.filter("_cuts", lambda c: (h < c.cut_h) | ((h == c.cut_h) & (i <= c.cut_id)))
    return (
        seeded.join(F.broadcast(by_seed), "seed")
        .withColumn("step", F.get(inside, F.lit(0)).getField("cut"))
        .drop("_cuts")
    )


def review_sheet(df: DataFrame, n: int = REVIEW_ROWS, seed: int = 0, row_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Random rows for blind reading: id and text, no label."""
    return smallest(df.select(row_id, text), n, seed, row_id)


def fingerprint(df: DataFrame, groups: list[str], row_id: str = "doc_id",
                id_bits: int = ID_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Order-free digest of the ids of each group: first 12 hex digits of a sha1.

    Ids that fit one leaf give the sha1 of the sorted, comma-joined ids. Larger
    sets are hashed as a tree over id ranges, so no node holds more than
    ``2 ** id_bits`` ids or ``2 ** fan_bits`` digests. Ids must be unique.
    """
    def join(items):
        return F.array_join(F.transform(items, lambda x: x["v"].cast("string")), ",")

    node = F.shiftright(F.col(row_id).cast("bigint"), id_bits)
    level = (
        df.groupBy(*groups, node.alias("node"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("v")))).alias("items"))
        .select(*groups, "node", F.sha1(join(F.col("items")).cast("binary")).alias("v"))
    )
    left = 64 - id_bits
    while left > 0:
        up = F.shiftright(F.col("node"), min(fan_bits, left))
        items = F.sort_array(F.collect_list(F.struct("node", "v")))
        level = level.groupBy(*groups, up.alias("up")).agg(items.alias("items")).select(
            *groups, F.col("up").alias("node"),
            F.when(F.size("items") == 1, F.col("items")[0]["v"])
            .otherwise(F.sha1(join(F.col("items")).cast("binary"))).alias("v"),
        )
        left -= fan_bits
    # Negative and non-negative ids end in two different nodes.
    last = F.sort_array(F.collect_list(F.struct("node", "v")))
    return level.groupBy(*groups).agg(last.alias("items")).select(
        *groups,
        F.substring(
            F.when(F.size("items") == 1, F.col("items")[0]["v"])
            .otherwise(F.sha1(join(F.col("items")).cast("binary"))), 1, 12
        ).alias("fingerprint"),
    )
