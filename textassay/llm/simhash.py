"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance, components."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import LOWER, SPACES, narrow, slices
from textassay.operators.neardup import clusters
from textassay.session import settle

DISTANCE = 3
# 64 bits in six blocks: three differing bits leave three blocks alike, about 32 bits to join on.
BLOCKS = 6
# A bucket with more fingerprints is linked through neighbouring bit patterns, not pair by pair.
BUCKET = 1_024
SEED = 42
_PART = 1 << 14
_WORDS = re.compile(b"[^" + re.escape(SPACES) + b"]+")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of each bit over the XXH64 of all word shingles; zero without words.

    A bit is 1 if set in over half the hashes. Fewer words than ``shingle`` are one shingle.
    """
    words = _WORDS.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _PART):
        stop = min(count, start + _PART)
        hashed = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(start, stop)), np.uint64, stop - start
        )
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (the 64 bits as a signed long)."""
    def task(batches):
        for part in slices(batches, "text", 1 << 20):
            bits = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    rows = narrow(df, doc_id=row_id, text=text)
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of all sets of ``blocks - distance`` blocks; close pairs agree under at least one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    return [_signed(sum(chosen)) for chosen in combinations(one, blocks - distance)]


def _apart(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _crowded_links(bits: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of crowded buckets, a number in proportion to the fingerprints.

    A pair at most ``distance`` apart has a bit pattern that is at most ``near`` bits from
    one and ``far`` bits from the other, near + far = distance. Everything within ``far`` of
    a pattern is linked to the smallest fingerprint within ``near`` of it: all these links
    are at most ``distance`` long, and the pair hangs together through that one.
    """
    near = distance // 2
    rings = [[_signed(sum(1 << k for k in chosen)) for chosen in combinations(range(64), n)] for n in range(distance - near + 1)]

    def patterns(upto):
        flips = F.array(*(F.lit(x) for ring in rings[: upto + 1] for x in ring)) if upto < 2 else None
        if flips is None:
            # Radius two and more: XOR of single flips, built from two short lists.
            single = F.array(*(F.lit(x) for ring in rings[:2] for x in ring))
            once = bits.select("bits", F.explode(single).alias("_f"))
            for _ in range(upto - 1):
                once = once.select("bits", F.explode(F.transform(single, lambda x: x.bitwiseXOR(F.col("_f")))).alias("_f"))
            return once.select("bits", F.col("bits").bitwiseXOR(F.col("_f")).alias("pattern"))
        return bits.select("bits", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("bits")))).alias("pattern"))

    hubs = patterns(near).groupBy("pattern").agg(F.min("bits").alias("hub"))
    found = patterns(distance - near).join(hubs, "pattern").filter("hub != bits")
    return found.select(F.least("bits", "hub").alias("a"), F.greatest("bits", "hub").alias("b")).distinct()


def links(bits: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints (column ``bits``), enough to connect
    all that are at most ``distance`` apart; every link is at most ``distance`` long.

    In buckets of up to ``bucket`` fingerprints these are all close pairs. Larger buckets
    go through ``_crowded_links``, which skips pairs that are linked by way of another.
    """
    masks = block_masks(distance, blocks)
    entries = settle(bits.select("bits", F.explode(F.array(*(
        F.struct(F.lit(k).alias("block"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key")) for k, mask in enumerate(masks)
    ))).alias("_e")).select("bits", "_e.*"))
    sizes = entries.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settle(entries.join(sizes, ["block", "key"]))
    few = shared.filter(F.col("n") <= bucket)
    pairs = (
        few.select("block", "key", F.col("bits").alias("a")).join(few.select("block", "key", F.col("bits").alias("b")), ["block", "key"])
        .filter((F.col("a") < F.col("b")) & (_apart("a", "b") <= distance)).select("a", "b")
    )
    crowded = settle(shared.filter(F.col("n") > bucket).select("bits").distinct())
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_crowded_links(crowded, distance))
    return pairs.distinct()


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``distance``
    differing bits, the row's own included. Null, empty and blank texts have fingerprint
    zero and are linked as any other. Equal texts share a fingerprint, so copies are one
    node however many there are. doc_id is taken to be unique; rows with a null id keep a
    row and take the smallest id of their group, null if it has none. Other columns are ignored.
    """
    rows = settle(fingerprints(df, row_id, text))
    classes = settle(rows.groupBy(F.col("fingerprint").alias("bits")).agg(F.min("doc_id").alias("first")))
    found = settle(links(classes.select("bits"), distance))
    if found.isEmpty():
        groups = classes.select("bits", F.col("first").alias("component_id"))
    else:
        members = settle(clusters(found).select(F.col("id").alias("bits"), "cluster").join(classes, "bits"))
        firsts = members.groupBy("cluster").agg(F.min("first").alias("component_id"))
        joined = members.join(firsts, "cluster").select("bits", "component_id")
        alone = classes.join(members.select("bits"), "bits", "left_anti").select("bits", F.col("first").alias("component_id"))
        groups = joined.unionByName(alone)
    return rows.join(groups.withColumnRenamed("bits", "fingerprint"), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
