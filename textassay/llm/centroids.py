"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm.

Every dimension has a list of the centroids sorted by their component. A vector finds its place in
each list and walks outward, always to the nearer neighbour; a centroid met for the first time gets
its exact distance. Whatever no list has shown yet is at least as far away, in every dimension, as
that list's frontier. The walk ends when the squared frontier distances add up to strictly more than
the best exact distance, so ties are still seen. All vectors of a slice walk side by side.

The vectors are written once; each round is one pass over them that sends one row of sums per task
and cluster. Only centroids are on the driver.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import narrow
from textassay.llm.vectors import is_finite, scaled
from textassay.session import settle

SCALE = 64
CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SLICE_ROWS = 2048
_FAR = np.iinfo(np.int64).max


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number."""
    n, k = len(x), len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    right = np.stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((n, 0), np.int64)
    left = right - 1
    dims = np.arange(x.shape[1])
    seen = np.zeros((n, k), bool)
    best, distance = np.zeros(n, np.int32), np.full(n, _FAR)
    live = np.arange(n)
    for step in range(k):
        own, low, high = x[live], left[live], right[live]
        below = np.where(low >= 0, own - lists[np.maximum(low, 0), dims], _FAR)
        above = np.where(high < k, lists[np.minimum(high, k - 1), dims] - own, _FAR)
        frontier = np.minimum(below, above)
        # While a centroid is unseen, no list is at its end.
        going = (frontier * frontier).sum(axis=1) <= distance[live]
        if step == 0:
            going[:] = True
        live, low, high, up = live[going], low[going], high[going], (above < below)[going]
        if not len(live):
            break
        shown = np.zeros((len(live), k), bool)
        if len(dims):
            np.put_along_axis(shown, order[np.where(up, high, low), dims], True, axis=1)
        else:
            shown[:] = True
        row, number = np.nonzero(shown & ~seen[live])
        seen[live] |= shown
        gap = x[live[row]] - centroids[number]
        exact = np.full((len(live), k), _FAR)
        exact[row, number] = (gap * gap).sum(axis=1)
        found = exact.argmin(axis=1)  # the first of equals
        value = exact[np.arange(len(live)), found]
        closer = (value < distance[live]) | ((value == distance[live]) & (found < best[live]))
        best[live[closer]], distance[live[closer]] = found[closer], value[closer]
        right[live], left[live] = high + up, low - ~up
        live = live[~seen[live].all(axis=1)]
        if not len(live):
            break
    return best, distance


def _limit(width: int) -> int:
    """Components below this have squared distances that fit into a long."""
    return 1 << int((62 - np.log2(max(1, width))) // 2 - 1)


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _vectors(df: DataFrame, row_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """Settled vec_id and whole components of the vectors that take part."""
    rows = narrow(df, vec_id=row_id, v=vector)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))

    def task(batches):
        for batch in _slices(batches):
            whole = scaled(batch.column(1), scale, _limit(width)).astype(np.int32)
            ends = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], ["vec_id", "v"])

    kept = rows.filter((F.size("v") == width) & is_finite(F.col("v")))
    return settle(kept.mapInArrow(task, "vec_id long, v array<int>"))


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    width = centroids.shape[1]

    def task(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column(1), width)
            own, _ = nearest(x, centroids)
            count += np.bincount(own, minlength=len(count))
            np.add.at(total, own, x)
        filled = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array(count[filled]), pa.array(list(total[filled]), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    parts = vectors.mapInArrow(task, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # one row per cluster
        moved[row.cluster] = [row[f"s{d}"] // row.n for d in range(width)]
    return moved


def cluster(
    df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Settled vec_id, cluster and distance of every vector that takes part, and the final centroids.

    Vectors that are null, have another number of components than ``width`` or hold a null or non-finite
    one take no part; the others become ``floor(scale * x)``. The first centroids are the vectors with the
    smallest hex SHA-256 of ``1:<id>`` (a null id: of ``1:``), equal hashes in order of their components;
    with fewer vectors there are fewer centroids. Each round moves every centroid to the exact floor of
    its vectors' mean; a centroid without vectors stays. Distances are squared. Equal vectors fall into
    one cluster, rows that repeat an id are rows of their own, and an empty table gives no rows. A
    component so large that distances overflow is an error. Other columns are ignored.
    """
    vectors = _vectors(df, row_id, vector, width, scale)
    place = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(place.alias("place"), "v").orderBy("place", "v").limit(clusters).collect()
    centroids = np.array([row.v for row in first], np.int64).reshape(len(first), width)
    if len(first):
        centroids = reduce(lambda now, _: _moved(vectors, now), range(rounds), centroids)

    def task(batches):
        for batch in _slices(batches):
            own, distance = nearest(_matrix(batch.column(1), width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return settle(vectors.mapInArrow(task, "vec_id long, cluster int, distance long")), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row per vector."""
    sums = {row.cluster: row.total for row in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(sums.values())
    rows = [
        (c, total, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in sums.items()
    ]
    listed = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster.
    return found.join(F.broadcast(listed), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
