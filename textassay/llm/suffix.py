"""Removal of byte strings that an earlier document holds, with a suffix array per shard.

Distinct texts are packed into shards of two megabytes, kept as files in the shared folder.

1. Every 50-byte string has a key: the least hash of the 16-byte strings inside it. Equal strings
   have equal keys, and neighbours mostly share one, so keys are few. Each shard sends its distinct
   keys to the bucket of their hash range; a key that only one shard holds can't repeat elsewhere.
2. Each shard sorts the suffixes of the regions whose keys are shared (prefix doubling on the groups
   that are still tied) and finds equal 50-byte strings by their common prefixes (Kasai). Of each
   string only the shard's first document goes on to the other shards.
3. In each bucket the strings of all shards are sorted by hash, a part of the hashes at a time, and each
   string is held against the smallest document that has it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import flat, mix, release, ship, slices, task_number
from textassay.llm.files import Output, new_folder, opened
from textassay.session import settle

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
SHARD_BYTES = 2 << 20
# Positions whose keys are worked out at a time.
KEY_BYTES = 256 << 10
# Text that one bucket of the hash range stands for, and strings of a bucket that are compared at a time.
BUCKET_BYTES = 16 << 20
PASS_STARTS = 1 << 19
_KASAI_STEPS = 64
_LANE_OFFSETS = (*range(0, LENGTH - 8, 8), LENGTH - 8)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(2 * LENGTH + 16, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by at least their first ``depth`` bytes, and which of them tie with the one before.

    Starts from eight bytes and doubles; each round sorts only suffixes in groups that still tie,
    by their group and the group of the suffix that many bytes on. Places are 32-bit integers.
    """
    n = len(data)
    key = lanes(data)[:n].byteswap()
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    rank = np.empty(n, np.int32)
    rank[order] = _group_starts(new, np.arange(n, dtype=np.int32))
    known = 8
    while known < depth:
        at = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        if not len(at):
            break
        suffix = order[at]
        key = rank[suffix].astype(np.int64)
        key <<= 32
        tail = rank[np.minimum(suffix + known, n - 1)]
        tail += 1
        tail[suffix >= n - known] = 0
        key |= tail
        del tail
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        del by
        order[at] = suffix
        new[at[0]] = True
        new[at[1:]] = key[1:] != key[:-1]
        del key
        rank[suffix] = _group_starts(new[at], at)
        known *= 2
    return order, ~new


def _group_starts(new: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each ascending place the last one at or before it that begins a group."""
    return np.maximum.accumulate(np.where(new, at, np.int32(0)))


def common_prefixes(data: np.ndarray, order: np.ndarray, tied: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix of the order has in common with the one before it, at most ``cap``.

    Kasai's walk in text order: the common prefix of the next suffix is at least one shorter. The
    text is cut into pieces that are walked side by side. Tied suffixes have at least ``cap`` bytes in
    common; as their order among themselves is open, the walk begins anew after them.
    """
    n = len(order)
    eight = lanes(data)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    common = np.zeros(n, np.uint8 if cap < 256 else np.int32)
    starts = np.arange(0, n, _KASAI_STEPS)
    have = np.zeros(len(starts), np.int64)
    for step in range(_KASAI_STEPS):
        i = starts + step
        if i[-1] >= n:
            i = i[i < n]
            have = have[: len(i)]
        at = place[i]
        before = order[np.maximum(at, 1) - 1]
        tie = tied[at]
        have = np.maximum(have - 1, 0)
        live = np.flatnonzero((at > 0) & ~tie)
        have[at == 0] = 0
        while len(live):
            differ = eight[i[live] + have[live]] ^ eight[before[live] + have[live]]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            have[live] += same
            live = live[(same == 8) & (have[live] < cap)]
        have = np.minimum(have, cap)
        common[at] = np.where(tie, cap, have)
        have[tie] = 0
    return common


def start_keys(data: np.ndarray, n: int) -> np.ndarray:
    """The least hash of ``GRAM`` bytes among the ``LENGTH`` bytes from each of the first ``n`` positions on."""
    eight = lanes(data)
    least, width = mix(mix(eight[: n + SPAN]) ^ eight[GRAM - 8 : n + SPAN + GRAM - 8]), 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least[:n]


class Shard:
    """Texts of one shard: bytes, bounds, and runs of starts with one key.

    Keys are worked out for ``KEY_BYTES`` positions at a time; a run may end there and go on as another.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int):
        self.data, self.offsets = data, offsets
        parts = [self._runs(start, min(len(data), start + KEY_BYTES)) for start in range(0, len(data), KEY_BYTES)]
        run, length, key = zip(*parts) if parts else ((np.zeros(0, np.int32),), (np.zeros(0, np.int32),), (np.zeros(0, np.uint64),))
        self.run, self.length = np.concatenate(run), np.concatenate(length)
        self.text = (np.searchsorted(offsets, self.run, "right") - 1).astype(np.int32)
        # Enough of the mixed key to tell strings of one bucket apart; a chance match only costs work.
        self.key = mix(np.concatenate(key)) >> np.uint64(32 - bits)

    def _runs(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and least hash of the runs of valid starts between two positions."""
        n = stop - start
        least = start_keys(self.data[start : stop + LENGTH], n)
        first, last = np.searchsorted(self.offsets, (start, stop - 1), "right") - 1
        ends = self.offsets[first + 1 : last + 2]
        bounds = np.clip(np.append(self.offsets[first : last + 1], stop), start, stop) - start
        valid = np.arange(start + LENGTH, stop + LENGTH) <= np.repeat(ends, np.diff(bounds))
        change = np.ones(n, bool)
        change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        change[bounds[:-1][np.diff(bounds) > 0]] = True
        runs = np.flatnonzero(change)
        length = np.diff(np.append(runs, n))
        kept = valid[runs]
        runs, length = runs[kept], length[kept]
        return (runs + start).astype(np.int32), length.astype(np.int32), least[runs]

    def keys(self) -> np.ndarray:
        return np.unique(self.key)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose key another text or shard holds, and the run of each. ``shared``: sorted keys of other shards."""
        order = np.argsort(self.key, kind="stable")
        key, text = self.key[order], self.text[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        lead = text[np.flatnonzero(first)]
        several = np.zeros(len(lead), bool)
        several[group[text != lead[group]]] = True
        repeated = np.zeros(len(key), bool)
        repeated[order] = several[group]
        repeated |= contained(self.key, shared)
        good = np.flatnonzero(repeated).astype(np.int32)
        return expand(self.run[good], self.length[good]).astype(np.int32), np.repeat(good, self.length[good])


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs given by start and length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def contained(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds, by binary search."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def spans_of(positions: np.ndarray) -> np.ndarray:
    """Ascending positions as an array of (start, length) runs."""
    if not len(positions):
        return np.zeros((0, 2), np.uint32)
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    first = np.concatenate([[0], cut])
    return np.column_stack([positions[first], np.diff(np.append(first, len(positions)))]).astype("<u4")


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the runs given by ascending or unordered start and length."""
    edge = np.bincount(starts, minlength=n + 1).astype(np.int32)
    edge -= np.bincount(starts + lengths, minlength=n + 1).astype(np.int32)
    return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def local_repeats(shard: Shard, firsts: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts that an earlier document of the shard holds; first-document starts to compare with
    other shards, and the run of each."""
    start, run = shard.candidates(shared)
    if not len(start):
        return start, start, run
    region = covered(start, LENGTH, len(shard.data))
    at = (np.cumsum(region, dtype=np.int32) - 1)[start]
    data = shard.data[region]
    del region
    order, tied = suffix_array(data, LENGTH)
    same = common_prefixes(data, order, tied, LENGTH) >= LENGTH
    del tied
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(~same, dtype=np.int32)
    del order, same
    group = group[at]
    del at
    # Documents by the order of their ids, which takes less room than the ids.
    own = np.unique(firsts, return_inverse=True)[1].astype(np.int32)[shard.text[run]]
    by = np.argsort(group, kind="stable").astype(np.int32)
    group = group[by]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    smallest = np.empty(len(group), np.int32)
    smallest[by] = np.repeat(np.minimum.reduceat(own[by], edges), np.diff(np.append(edges, len(by))))
    del by, group
    later = own > smallest
    sent = ~later & contained(shard.key, shared)[run]
    return start[later], start[sent], run[sent]


_PIECE_HEAD = 3


def pack_pieces(shard: Shard, firsts: np.ndarray, start: np.ndarray, run: np.ndarray, bits: int) -> list[dict]:
    """Per bucket one compressed blob: pieces (position, number of starts, document) and their bytes."""
    if not len(start):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(run) != 0)]))
    count = np.diff(np.append(first, len(start)))
    position, run = start[first], run[first]
    bucket = (shard.key[run] >> np.uint64(32)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    position, count, bucket, document = position[by], count[by], bucket[by], firsts[shard.text[run[by]]]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    squeeze = zstandard.ZstdCompressor(level=3)
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        text = shard.data[expand(position[a:b], count[a:b] + LENGTH - 1)]
        head = np.concatenate([[b - a], position[a:b], count[a:b], document[a:b]]).astype("<i8")
        out.append({"bucket": int(bucket[a]), "pieces": squeeze.compress(head.tobytes() + text.tobytes())})
    return out


def merge_pieces(blobs: list) -> list[np.ndarray]:
    """For each shard's blob the starts that an earlier document of another shard holds.

    Equal strings have equal hashes, so strings are compared in passes by their hash, about ``PASS_STARTS``
    of them at a time; only the texts and two bytes for each start are held throughout.
    """
    squeezed = zstandard.ZstdDecompressor()
    sizes = [zstandard.get_frame_parameters(blob).content_size for blob in blobs]
    data, heads, base = np.empty(sum(sizes), np.uint8), [], 0  # more than the texts alone: pages that nothing touches take no memory
    for blob in blobs:
        raw = squeezed.decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        text = np.frombuffer(raw, np.uint8, offset=8 + 8 * _PIECE_HEAD * n)
        heads.append(np.frombuffer(raw, "<i8", _PIECE_HEAD * n, 8).reshape(_PIECE_HEAD, n).copy())
        data[base : base + len(text)] = text
        base += len(text)
        del raw, text
    ends_of = np.cumsum([head.shape[1] for head in heads])
    position, count, document = np.concatenate(heads, axis=1)
    del heads
    width = count + LENGTH - 1
    place = np.cumsum(width) - width
    last = np.cumsum(count)
    first = last - count
    del width, count
    eight = np.ndarray((max(0, base - 7),), "<u8", data.data, 0, (1,))
    n = int(last[-1])

    def found(starts: np.ndarray, run: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        at = place[run] + (starts - first[run])
        hashed = np.full(len(at), seed, np.uint64)
        for offset in _LANE_OFFSETS:
            hashed = mix(hashed ^ eight[at + offset])
        return at, hashed

    passes = min(256, -(-n // PASS_STARTS))
    turn = np.zeros(n, np.uint8)
    for start in range(0, n if passes > 1 else 0, PASS_STARTS):
        starts = np.arange(start, min(n, start + PASS_STARTS))
        turn[start : start + PASS_STARTS] = (found(starts, np.searchsorted(last, starts, "right"), 0)[1] >> np.uint64(32)) % np.uint64(passes)
    gone = np.zeros(n, bool)
    for k in range(passes):
        starts = np.flatnonzero(turn == k)
        if not len(starts):
            continue
        run = np.searchsorted(last, starts, "right")
        seed = 0
        while True:
            seed += 1
            at, hashed = found(starts, run, seed)
            by = np.argsort(hashed)
            hashed, at = hashed[by], at[by]
            edges = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
            held = np.diff(np.append(edges, len(by)))
            lead = np.repeat(at[edges], held)
            if all((eight[at + offset] == eight[lead + offset]).all() for offset in _LANE_OFFSETS):
                break  # else two strings share a hash: take another
        own = document[run[by]]
        gone[starts[by[own > np.repeat(np.minimum.reduceat(own, edges), held)]]] = True
    out, start = [], 0
    for stop in (last[end - 1] if end else 0 for end in ends_of):
        later = np.flatnonzero(gone[start:stop]) + start
        run = np.searchsorted(last, later, "right")
        out.append(np.sort(position[run] + (later - first[run])))
        start = stop
    return out


def _write_shards(texts: DataFrame, folder: str) -> DataFrame:
    """Pack texts into shard files; one settled row per shard says where it is and what it holds."""
    def task(batches):
        number = task_number()
        squeeze = zstandard.ZstdCompressor(level=3)
        out = None
        for part in slices(batches, "text", SHARD_BYTES):
            out = out or Output(folder, ".shard")
            data, offsets = flat(part.column(0))
            blob = squeeze.compress(data.tobytes())
            digests = b"".join(hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:]))
            firsts = part.column(1).to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([out.name]), pa.array([out.append(blob)]), pa.array([len(blob)]),
                 pa.array([len(data)]), *(pa.array([x], pa.binary()) for x in (offsets.astype("<i8").tobytes(), firsts.tobytes(), digests))],
                ["shard", "file", "place", "size", "n_bytes", "offsets", "firsts", "digests"],
            )
            number += 1
        if out is not None:
            out.close()

    return settle(texts.mapInArrow(
        task, "shard long, file string, place long, size long, n_bytes long, offsets binary, firsts binary, digests binary"
    ))


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    system, path = opened(row["file"])
    with system.open_input_file(path) as source:
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(row["size"], row["place"]))
    return np.frombuffer(raw, np.uint8), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["firsts"], "<i8")


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
            release()


_WHERE = ("file", "place", "size", "offsets", "firsts")


def _shared_keys(shards: DataFrame, parts: int, bits: int) -> DataFrame:
    """Per shard and bucket the keys that other shards hold too: shard, bucket, keys."""
    def sent(batches):
        for row in _rows(batches):
            data, offsets, _ = _read(row)
            keys = Shard(data, offsets, bits).keys()
            cuts = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1))
            filled = np.flatnonzero(np.diff(cuts))
            low = keys.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int64()), pa.array([row["shard"]] * len(filled), pa.int64()),
                 pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary())],
                ["bucket", "shard", "keys"],
            )

    def several(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        merged, count = np.unique(np.concatenate(own), return_counts=True)
        shared = merged[count > 1]
        found = [x[contained(x, shared)] for x in own]
        some = [k for k, x in enumerate(found) if len(x)]
        return table.take(pa.array(some, pa.int64())).set_column(
            table.schema.get_field_index("keys"), "keys", pa.array([found[k].tobytes() for k in some], pa.binary())
        )

    keys = shards.select("shard", *_WHERE).repartition(parts, "shard").mapInArrow(sent, "bucket long, shard long, keys binary")
    return keys.groupBy("bucket").applyInArrow(several, "bucket long, shard long, keys binary")


def _compared(shards: DataFrame, shared: DataFrame, parts: int, bits: int) -> DataFrame:
    """Per shard its own repeats and the pieces for other shards, settled: shard, spans, sent."""
    listed = shared.groupBy("shard").agg(F.collect_list(F.struct("bucket", "keys")).alias("shared"))
    rows = shards.select("shard", *_WHERE).join(listed, "shard", "left").repartition(parts, "shard")

    def task(batches):
        for row in _rows(batches):
            data, offsets, firsts = _read(row)
            keys = [(x["bucket"] << 32) + np.frombuffer(x["keys"], "<u4").astype(np.int64) for x in row["shared"] or ()]
            shared = np.sort(np.concatenate(keys)).astype(np.uint64) if keys else np.zeros(0, np.uint64)
            shard = Shard(data, offsets, bits)
            later, start, run = local_repeats(shard, firsts, shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]]), pa.array([spans_of(later).tobytes()], pa.binary()),
                 pa.array([pack_pieces(shard, firsts, start, run, bits)], pa.list_(pa.struct([("bucket", pa.int64()), ("pieces", pa.binary())])))],
                ["shard", "spans", "sent"],
            )

    return settle(rows.mapInArrow(task, "shard long, spans binary, sent array<struct<bucket:long,pieces:binary>>"))


def _merged(compared: DataFrame) -> DataFrame:
    """Repeats of strings that an earlier document of another shard holds: shard, spans."""
    def merge(table: pa.Table) -> pa.Table:
        found = [spans_of(x).tobytes() for x in merge_pieces([x.as_buffer() for x in table.column("pieces")])]
        release()
        return pa.table({"shard": table.column("shard"), "spans": pa.array(found, pa.binary())})

    pieces = compared.select("shard", F.inline("sent"))
    return pieces.groupBy("bucket").applyInArrow(merge, "shard long, spans binary").filter(F.octet_length("spans") > 0)


def _removed(shards: DataFrame, compared: DataFrame, parts: int, texts: bool) -> DataFrame:
    """One row per distinct text: digest, first, n_removed, n_spans, kept_sha256 and, if asked for, kept."""
    both = compared.select("shard", "spans").unionByName(_merged(compared))
    listed = both.groupBy("shard").agg(F.collect_list("spans").alias("spans"))
    rows = shards.select("shard", *_WHERE, "digests").join(listed, "shard", "left").repartition(parts, "shard")

    def task(batches):
        for row in _rows(batches):
            data, offsets, firsts = _read(row)
            spans = [np.frombuffer(blob, "<u4").reshape(-1, 2) for blob in row["spans"] or ()]
            start, length = np.concatenate([np.zeros((0, 2), "<u4"), *spans]).astype(np.int64).T
            gone = covered(start, length + LENGTH - 1, len(data))
            digests, n_removed, n_spans, sha, kept = [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = gone[a:b]
                left = data[a:b][~own].tobytes()
                digests.append(row["digests"][32 * k : 32 * k + 32].hex())
                n_removed.append(int(own.sum()))
                n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode(errors="ignore") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests), pa.array(firsts), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha),
                 pa.array(kept, pa.string())],
                ["digest", "first", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.mapInArrow(task, "digest string, first long, n_removed long, n_spans long, kept_sha256 string, kept string")


def deduplicate(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", texts: bool = False, carried: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept.

    A byte goes if it lies in a 50-byte string of its text that a text with a smaller doc_id holds
    too; overlapping strings count and all are judged on the input. kept is the text without those
    bytes, and without characters that lost some of theirs. Null and empty texts have no bytes (kept
    is null for null); texts under 50 bytes stay whole. Rows that share a doc_id never remove bytes
    from each other, except that copies of one text stand and fall with its smallest doc_id; rows with
    a null doc_id stay whole and remove nothing. doc_id must be an integer column. ``carried`` columns
    come along in a struct of that name; other columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select(
        F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{x}`") for x in carried)).alias("carried")
    )
    # Copies collapse before the shuffle, so a text that a third of the rows hold is one row per task.
    distinct = rows.filter((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()).groupBy("text").agg(F.min("doc_id").alias("first"))
    shards = _write_shards(distinct, new_folder(df.sparkSession, "shards"))
    count, total = shards.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    bits = min(24, max(8, math.ceil(math.log2(max(1, total) / BUCKET_BYTES))))
    parts = max(1, int(count))
    shared = settle(_shared_keys(shards, parts, bits))
    compared = _compared(shards, shared, parts, bits)
    found = _removed(shards, compared, parts, texts)
    whole = F.coalesce("text", F.lit(""))
    own = rows.select(
        "doc_id", "carried", F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("n_bytes"),
        # Texts in a shard come back from there; only the others travel with their rows.
        *([F.when((F.octet_length("text") < LENGTH) | F.col("doc_id").isNull(), F.col("text")).alias("text")] if texts else [])
    )
    joined = own.join(found, "digest", "left").withColumns({
        "whole": F.col("first").isNull() | F.col("doc_id").isNull(), "copy": F.col("doc_id") > F.col("first"),
    })

    def choose(whole, copy, first):
        return F.when(F.col("whole"), whole).when(F.col("copy"), copy).otherwise(first)

    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "doc_id", "n_bytes", choose(zero, F.col("n_bytes"), F.col("n_removed")).alias("n_removed"),
        choose(zero, F.lit(1).cast("long"), F.col("n_spans")).alias("n_spans"),
        choose(F.col("digest"), empty, F.col("kept_sha256")).alias("kept_sha256"),
        *([choose(F.col("text"), F.lit(""), F.col("kept")).alias("kept")] if texts else []), *(["carried"] if carried else []),
    )
