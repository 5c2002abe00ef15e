"""Helpers the operators share: bounded slices of Arrow batches, word bounds, hashes, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.session import release, ship

# Text that one slice of a batch holds; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def slices(batches, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of ``text`` each; freed memory goes back at the end."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = base = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]
    release()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the n + 1 offsets of its values."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if values.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 booleans."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


NOT_SPACE = ~byte_class(SPACES)
WORD = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; no run crosses a position of ``breaks``."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = breaks[(breaks > 0) & (breaks < len(mask))]
    start, last = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    start[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _K1
    h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return h


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) ^ _K2)
    h = mix(h ^ (lanes[starts] & _LANE_MASKS[np.minimum(left, 8)]))
    live = np.flatnonzero(left > 8)
    at, left = starts[live] + 8, left[live] - 8
    while len(live):
        h[live] = mix(h[live] ^ (lanes[at] & _LANE_MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two neighbours of ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def task_number() -> int:
    """A number that no other task of the stage has, with room for 2^32 rows each."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; other columns of the input can't clash."""
    ship(df.sparkSession)
    return df.select(*(F.col(f"`{column}`").alias(name) for name, column in columns.items()))
