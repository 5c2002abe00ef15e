"""Joins on keys of which a few may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than 1/HEAVY_SHARE of all rows, so there are
# fewer than HEAVY_SHARE heavy keys whatever the data looks like.
HEAVY_SHARE = 10_000
MIN_HEAVY_ROWS = 1_000


def heavy_keys(lookup: DataFrame, key: str, count: str) -> DataFrame:
    """Heavy keys and how many pieces each is cut into; small by the pigeonhole principle.

    ``lookup`` has one row per key with the key's row count. A piece holds at most
    1/HEAVY_SHARE of all rows, so all pieces together number below 2 x HEAVY_SHARE.
    """
    floor = lookup.agg(F.greatest(F.sum(count) / HEAVY_SHARE, F.lit(MIN_HEAVY_ROWS)).alias("_floor"))
    return (
        lookup.select(key, count).join(F.broadcast(floor)).filter(F.col(count) > F.col("_floor"))
        .select(key, F.ceil(F.col(count) / F.col("_floor")).cast("int").alias("_pieces"))
    )


def join_by_frequency(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread_by: str) -> DataFrame:
    """Inner join of ``rows`` to a one-row-per-key ``lookup`` that knows each key's row count.

    Rows of heavy keys are spread over that key's pieces by a hash of ``spread_by``;
    the lookup row is repeated once per piece. One shuffle of ``rows``, none dropped.
    """
    heavy = F.broadcast(heavy_keys(lookup, key, count))
    marked = rows.join(heavy, key, "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.hash(spread_by), F.col("_pieces")), F.lit(0))
    )
    copies = lookup.join(heavy, key, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    )
    return marked.drop("_pieces").join(copies.drop("_pieces"), [key, "_piece"]).drop("_piece")
