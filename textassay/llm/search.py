"""Exact search for the largest inner products with a KD-tree in every shard.

Vectors are packed into shards of ``SHARD_ROWS`` rows in files of the shared folder. A shard's rows are
split at the median of their widest dimension down to leaves; every node keeps its tight box and its
smallest id. For one query the best product that a box can hold follows from its corners, and a
traversal always opens the open node with the best one. It ends when no open node can reach the query's
k-th result so far. All queries of a block walk through a tree side by side, and products of a leaf
with the queries that opened it are one matrix product.

The k-th result is handed on: a query starts with that of its own shard, and takes it along from shard
to shard of a file. Blocks of queries meet files as rows of names and places, so no vectors are
shuffled; what a block finds in a file goes on as at most k rows a query.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.common import ship, task_number
from textassay.llm.files import Output, new_folder, opened
from textassay.llm.vectors import is_finite, scaled
from textassay.session import settle

SCALE = 64
TOP = 20
SHARD_ROWS = 8192
LEAF_ROWS = 256
FILE_SHARDS = 256
BLOCK_QUERIES = 1024
# Whole numbers up to here are exact as doubles, so products may use the floating-point routine.
_EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; the narrower one ends in zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    if largest >= 1 << 63:
        raise OverflowError("an inner product may not fit into a long")
    if largest < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree:
    """A shard's vectors in the order of a KD-tree's leaves, and the nodes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, query: np.ndarray):
        order = np.argsort(ids, kind="stable")
        # An explicit stack keeps rows ascending by id inside each leaf.
        stack, nodes, leaves, filled = [(order, -1, 0)], [], [], 0
        while stack:
            rows, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            part = x[rows]
            spread = part.max(axis=0) - part.min(axis=0) if part.shape[1] else np.zeros(1, np.int64)
            if len(rows) <= LEAF_ROWS or not spread.any():
                nodes.append([filled, filled + len(rows), -1, -1])
                leaves.append(rows)
                filled += len(rows)
                continue
            nodes.append([0, 0, -1, -1])
            by = np.argsort(part[:, spread.argmax()], kind="stable")
            half = len(rows) // 2
            stack.append((rows[np.sort(by[half:])], at, 1))
            stack.append((rows[np.sort(by[:half])], at, 0))
        rows = np.concatenate(leaves)
        self._fill(x[rows], ids[rows], query[rows], np.array(nodes, np.int64))

    def _fill(self, x, ids, query, nodes):
        self.x, self.ids, self.query, self.nodes = x, ids, query, nodes
        m, width = len(nodes), x.shape[1]
        self.low, self.high, self.least = np.zeros((m, width), np.int64), np.zeros((m, width), np.int64), np.zeros(m, np.int64)
        for k in range(m - 1, -1, -1):  # children come after their parent
            start, stop, left, right = nodes[k]
            if left < 0:
                self.low[k], self.high[k], self.least[k] = x[start:stop].min(axis=0), x[start:stop].max(axis=0), ids[start:stop].min()
            else:
                self.low[k], self.high[k] = np.minimum(self.low[left], self.low[right]), np.maximum(self.high[left], self.high[right])
                self.least[k] = min(self.least[left], self.least[right])

    def packed(self, **more: np.ndarray) -> bytes:
        out, largest = io.BytesIO(), int(np.abs(self.x).max(initial=0))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
        np.savez(out, x=self.x.astype(kind), ids=self.ids, query=self.query, nodes=self.nodes, **more)
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def unpacked(cls, blob: bytes) -> tuple[Tree, dict]:
        parts = dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))))
        tree = cls.__new__(cls)
        tree._fill(parts.pop("x").astype(np.int64), parts.pop("ids"), parts.pop("query"), parts.pop("nodes"))
        return tree, parts


class Found:
    """The best k results of each query so far: scores descending, equal scores by ascending id."""

    def __init__(self, n: int, k: int, floor: tuple[np.ndarray, np.ndarray] | None = None):
        self.k = k
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), _NO_ID)
        # A k-th result known beforehand; results equal to it are still taken.
        self.floor_score, self.floor_id = floor or (np.full(n, _NONE), np.full(n, _NO_ID))

    def may_enter(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which (score, id) beat a query's k-th result; ``score`` has one line per row of ``rows``."""
        last, last_id = self.score[rows, -1][:, None], self.id[rows, -1][:, None]
        floor, floor_id = self.floor_score[rows][:, None], self.floor_id[rows][:, None]
        full = last > _NONE
        beats = (score > last) | ((score == last) & (ids < last_id)) | ~full
        return beats & ((score > floor) | ((score == floor) & (ids <= floor_id)))

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        line, column = np.nonzero(self.may_enter(rows, score, ids) & (score > _NONE))
        if not len(line):
            return
        touched = np.unique(line)
        old_line = np.repeat(touched, self.k)
        old_score, old_id = self.score[rows[touched]].ravel(), self.id[rows[touched]].ravel()
        all_line = np.concatenate([old_line, line])
        all_score, all_id = np.concatenate([old_score, score[line, column]]), np.concatenate([old_id, ids[column]])
        # Descending scores without negation, which the smallest long would overflow.
        by = np.lexsort((all_id, ~all_score, all_line))
        all_line = all_line[by]
        first = np.flatnonzero(np.append(True, all_line[1:] != all_line[:-1]))
        pick = by[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[rows[touched]] = all_score[pick].reshape(-1, self.k)
        self.id[rows[touched]] = all_id[pick].reshape(-1, self.k)


def traverse(tree: Tree, queries: np.ndarray, found: Found, own: np.ndarray | None = None) -> None:
    """Add a tree's best results to ``found``; ``own`` holds each query's own position in the tree."""
    width = min(queries.shape[1], tree.x.shape[1])
    q = queries[:, :width]
    bound = products(np.maximum(q, 0), tree.high[:, :width]) + products(np.minimum(q, 0), tree.low[:, :width])
    is_open = np.zeros(bound.shape, bool)
    is_open[:, 0] = True
    live = np.arange(len(q))
    while len(live):
        is_open[live] &= found.may_enter(live, bound[live], tree.least[None, :])
        live = live[is_open[live].any(axis=1)]
        if not len(live):
            break
        node = np.where(is_open[live], bound[live], _NONE).argmax(axis=1)
        # A bound may itself be the smallest long.
        node = np.where(is_open[live, node], node, is_open[live].argmax(axis=1))
        is_open[live, node] = False
        left = tree.nodes[node, 2]
        inner = left >= 0
        is_open[live[inner], left[inner]] = True
        is_open[live[inner], tree.nodes[node[inner], 3]] = True
        for leaf in np.unique(node[~inner]):
            rows = live[node == leaf]
            start, stop = tree.nodes[leaf, :2]
            score = products(q[rows], tree.x[start:stop, :width])
            if own is not None:
                at = own[rows] - start
                inside = (at >= 0) & (at < stop - start)
                score[np.flatnonzero(inside), at[inside]] = _NONE
            found.take(rows, score, tree.ids[start:stop])


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])


def _write_shards(rows: DataFrame, folder: str, scale: int, k: int) -> DataFrame:
    """Trees in files; one settled row per file with the place, size and queries of each of its shards."""
    def trees(batches):
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(start, SHARD_ROWS)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                x = scaled(part.column(1), scale, 1 << 31)
                query = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                held.append((x, ids, query))
                n += len(x)
                if n >= SHARD_ROWS:
                    yield held
                    held, n = [], 0
        if held:
            yield held

    def task(batches):
        out, number, rows = None, task_number(), []
        for held in trees(batches):
            tree = Tree(_padded([x for x, _, _ in held]), *(np.concatenate([part[c] for part in held]) for c in (1, 2)))
            own = np.flatnonzero(tree.query)
            found = Found(len(own), k)
            for start in range(0, len(own), BLOCK_QUERIES):
                part = Found(len(own[start : start + BLOCK_QUERIES]), k)
                traverse(tree, tree.x[own[start : start + BLOCK_QUERIES]], part, own[start : start + BLOCK_QUERIES])
                found.score[start : start + BLOCK_QUERIES], found.id[start : start + BLOCK_QUERIES] = part.score, part.id
            blob = tree.packed(floor_score=found.score[:, -1], floor_id=found.id[:, -1])
            if out is not None and len(rows) == FILE_SHARDS:
                out.close()
                yield _listed(out.name, rows)
                out, rows = None, []
            out = out or Output(folder, ".trees")
            rows.append((number, out.append(blob), len(blob), len(own)))
            number += 1
        if out is not None:
            out.close()
            yield _listed(out.name, rows)

    return settle(rows.mapInArrow(task, "file string, shards array<struct<shard:long,place:long,size:long,n_queries:long>>"))


def _listed(file: str, rows: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("shard", "place", "size", "n_queries")]))
    names = ("shard", "place", "size", "n_queries")
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([[dict(zip(names, row)) for row in rows]], kind)], ["file", "shards"])


@lru_cache(maxsize=4)
def _tree(file: str, place: int, size: int) -> tuple[Tree, dict]:
    system, path = opened(file)
    with system.open_input_file(path) as source:
        return Tree.unpacked(source.read_at(size, place))


def _search(items: DataFrame, k: int) -> DataFrame:
    """For every block of queries and every file the block's results: query, query_id, vec_id, score."""
    def task(batches):
        for batch in batches:
            for item in batch.to_pylist():
                tree, floor = _tree(item["block_file"], item["block"]["place"], item["block"]["size"])
                positions = np.flatnonzero(tree.query)
                for start in range(0, len(positions), BLOCK_QUERIES):
                    part = slice(start, start + BLOCK_QUERIES)
                    own = positions[part]
                    found = Found(len(own), k, (floor["floor_score"][part], floor["floor_id"][part]))
                    for shard in item["shards"]:
                        other, _ = _tree(item["file"], shard["place"], shard["size"])
                        traverse(other, tree.x[own], found, own if shard["shard"] == item["block"]["shard"] else None)
                    row, column = np.nonzero(found.score > _NONE)
                    ids, query_ids = found.id[row, column], tree.ids[own[row]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), item["block"]["shard"])), pa.array(own[row]), pa.array(query_ids, mask=query_ids == _NO_ID),
                         pa.array(ids, mask=ids == _NO_ID), pa.array(found.score[row, column])],
                        ["shard", "place", "query_id", "vec_id", "score"],
                    )

    return items.mapInArrow(task, "shard long, place long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, row_id: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """The k rows with the largest inner product for every row where ``is_query`` holds: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``; a vector that is null or holds a null or non-finite component
    takes no part, and components that a shorter vector lacks count as zero. A query meets every row but
    itself; rows that repeat its id or vector are rows like others. Ties go to the smaller id, null ids come
    last, and with fewer rows than k all are returned. ``is_query`` null is no query; an empty table gives
    no rows. Components of 2^31 or more after scaling, or products beyond a long, are errors. Ids are cast
    to long; the largest long stands for null. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(
        F.col(f"`{row_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    ).filter(is_finite(F.col("v")))
    files = _write_shards(rows, new_folder(spark, "trees"), scale, k)
    blocks = files.select(F.col("file").alias("block_file"), F.explode("shards").alias("block")).filter("block.n_queries > 0")
    n_files, n_blocks = files.count(), blocks.count()
    # One short row per file is numbered.
    numbered = files.withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
    meeting = blocks.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_files - 1))))).join(numbered, "number")
    items = meeting.select("block_file", "block", "file", "shards").repartition(int(min(max(1, n_files * n_blocks), max(64, n_files * n_blocks // 64))))
    by = Window.partitionBy("shard", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = _search(items, k).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
