"""Alignment of two tokenizers' tokens by diagonal run skipping, and how often token pairs are linked.

Both tokenizers cut the same bytes, so a token is known by the place where it ends. Where both arrays
of ends agree a group of tokens is complete. From such a place the arrays are compared at the current
index shift in stretches of 1, 2, 4, ... tokens: while they agree every token is a group of its own and
the stretch is jumped over. At the first difference the irregular group is resolved token by token up to
the next common end, which sets a new shift. A slice of many documents is cut into lanes at common ends,
and all lanes advance side by side.

Links are kept as distinct (document, A id, B id) with their number, one row per slice. Documents per id
pair are counted over the corpus; the table of pairs is written to the shared folder and read by the
tasks block by block, so neither links nor the table pass through a shuffle of documents or the driver.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.common import flat, narrow, slices
from textassay.llm.files import opened
from textassay.session import settle

SLICE_BYTES = 2 << 20
LANE_TOKENS = 256
# Pieces that a worker remembers with their ids.
PIECE_MEMORY = 400_000
PIECE_CHARS = 64
# Pairs of a task's slices that are looked up together, and pairs of the table that a worker keeps.
LOOKUP_PAIRS = 4_000_000
TABLE_PAIRS = 4_000_000
_SPACE = "▁"
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Tokenizer A (byte-level, tokenizers library) and B (sentencepiece) with the bytes of every id.

    Both cut a text before a single space between characters that are not white space: A's pattern does,
    and no entry of B holds a space after another character. Such pieces are encoded once and remembered;
    the space that B adds is that of the first piece. Other texts go to the libraries whole.
    """

    def __init__(self, a_json: bytes, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.a_bytes = [bytes(letters.get(c, 0) for c in x) for x in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(_SPACE, " ").encode() for k, x in enumerate(pieces)
        ]
        split = json.loads(a_json).get("pre_tokenizer") or {}
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any(_SPACE in x.lstrip(_SPACE) for x in pieces)
        )
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def _parts(self, text: str) -> list[str]:
        parts = text.split(" ") if self.cuts and _SPACE not in text and "\0" not in text else [text]
        if len(parts) > 1 and ("" in parts or any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACES)):
            return [text]
        return parts

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B as 32-bit integers; none where one of them does not give the text's bytes back."""
        known = self.known
        if len(known) > PIECE_MEMORY:
            for piece in list(islice(known, PIECE_MEMORY // 2, None)):
                del known[piece]
        cut = list(map(self._parts, texts))
        fresh = list(set(chain.from_iterable(cut)).difference(known))
        a = self.a.encode_batch_fast([" " + x for x in fresh], add_special_tokens=False)
        b = self.b.encode(fresh, num_threads=1)
        for piece, x, y in zip(fresh, a, b):
            whole, ids = (" " + piece).encode(), x.ids
            if not piece:
                # B adds no space to nothing; a text of this piece alone has no tokens, and no other text has it.
                known[piece] = (b"", b"", True)
                continue
            good = b"".join(map(self.a_bytes.__getitem__, ids)) == whole == b"".join(map(self.b_bytes.__getitem__, y))
            known[piece] = (np.array(ids, "<u4").tobytes(), np.array(y, "<u4").tobytes(), good)
        out = []
        for parts in cut:
            found = [known[x] for x in parts]
            out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])) if all([x[2] for x in found]) else (b"", b""))
        for piece in fresh:
            if len(piece) > PIECE_CHARS:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def _loaded(a_json: bytes, b_model: bytes) -> Tokenizers:
    """One pair of tokenizers per worker."""
    return Tokenizers(a_json, b_model)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs given by start and length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def lanes(a_end: np.ndarray, b_end: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both arrays right after common ends, about ``every`` tokens of A apart; the first is (0, 0)."""
    i = np.arange(every - 1, len(a_end), every)
    j = np.searchsorted(b_end, a_end[i])
    live = np.flatnonzero(b_end[j] != a_end[i])
    while len(live):  # the last ends are common
        i[live] += a_end[i[live]] < b_end[j[live]]
        more = a_end[i[live]] > b_end[j[live]]
        j[live] += more
        live = live[b_end[j[live]] != a_end[i[live]]]
    i = np.unique(i[i + 1 < len(a_end)])
    j = np.searchsorted(b_end, a_end[i])
    return np.append(0, i + 1), np.append(0, j + 1)


def align(a_end: np.ndarray, b_end: np.ndarray, lane: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B are the last of their group, from ascending ends with the same last one."""
    a_last, b_last = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    if not len(a_end):
        return a_last, b_last
    i, j = lanes(a_end, b_end, lane)
    i_stop, j_stop = np.append(i[1:], len(a_end)), np.append(j[1:], len(b_end))
    probe = np.ones(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        width = np.minimum(probe[live], np.minimum(i_stop[live] - i[live], j_stop[live] - j[live]))
        starts = np.cumsum(width) - width
        at_a, at_b = expand(i[live], width), expand(j[live], width)
        step = np.arange(len(at_a)) - np.repeat(starts, width)
        differ = a_end[at_a] != b_end[at_b]
        run = np.minimum.reduceat(np.where(differ, step, len(a_end)), starts)
        run = np.minimum(run, width)
        same = step < np.repeat(run, width)
        a_last[at_a[same]] = True
        b_last[at_b[same]] = True
        i[live] += run
        j[live] += run
        whole = run == width
        probe[live] = np.where(whole, 2 * width, 1)
        odd = live[~whole]
        while len(odd):
            x, y = a_end[i[odd]], b_end[j[odd]]
            equal = x == y
            done = odd[equal]
            a_last[i[done]] = True
            b_last[j[done]] = True
            i[odd] += x <= y
            j[odd] += x >= y
            odd = odd[~equal]
        live = live[i[live] < i_stop[live]]
    return a_last, b_last


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending, and the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys, weights = keys[by], weights[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first)


def links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, group_doc: np.ndarray, b_size: int):
    """Distinct (document, pair) with their number of links; pair is ``A id * b_size + B id``.

    Ids that a group repeats are counted before they are paired, so a long group costs its distinct ids.
    """
    n = len(group_doc)
    a_size, b_sizes = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    single = (a_size == 1) & (b_sizes == 1)
    one_a, one_b = single[a_group], single[b_group]
    pairs, doc, weight = [a[one_a] * b_size + b[one_b]], [group_doc[single]], [np.ones(int(single.sum()), np.int64)]
    key_a, n_a = _counted(a_group[~one_a] << 32 | a[~one_a])
    key_b, n_b = _counted(b_group[~one_b] << 32 | b[~one_b])
    group_a, group_b = key_a >> 32, key_b >> 32
    per_b = np.bincount(group_b, minlength=n)
    from_b = np.cumsum(per_b) - per_b
    times = per_b[group_a]
    left, right = np.repeat(np.arange(len(key_a)), times), expand(from_b[group_a], times)
    low = (1 << 32) - 1
    pairs.append((key_a[left] & low) * b_size + (key_b[right] & low))
    doc.append(group_doc[group_a[left]])
    weight.append(n_a[left] * n_b[right])
    return _counted(np.concatenate(doc) << 32 | np.concatenate(pairs), np.concatenate(weight))


def _joined_ids(a, b, a_last, b_last, a_group, b_group, doc_groups) -> tuple[np.ndarray, np.ndarray]:
    """Text ``a1,a2|b1;a3|b2`` of every document and the bounds of each; ``doc_groups`` are bounds of groups."""
    n = int(doc_groups[-1])
    a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    start = np.cumsum(a_size + b_size) - a_size - b_size
    at_a = np.arange(len(a)) + (np.cumsum(b_size) - b_size)[a_group]
    at_b = np.arange(len(b)) + np.cumsum(a_size)[b_group]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[a_last]] = 1
    mark[at_b[b_last]] = 2
    ends = np.append(start, len(ids))[doc_groups]
    mark[ends[1:][np.diff(doc_groups) > 0] - 1] = 3
    marks = pa.array([",", "|", ";", ""]).take(pa.array(mark))
    text = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), marks.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    data, offsets = flat(text)
    return data, offsets[ends]


def _aligned_slice(tokens: Tokenizers, doc_ids: pa.Array, texts: list) -> dict:
    """One settled row: per document its numbers and digest, and the slice's distinct links."""
    encoded = tokens.encode([x or "" for x in texts])
    n_a = np.array([len(x) // 4 for x, _ in encoded], np.int64)
    n_b = np.array([len(y) // 4 for _, y in encoded], np.int64)
    a = np.frombuffer(b"".join([x for x, _ in encoded]), "<u4").astype(np.int64)
    b = np.frombuffer(b"".join([y for _, y in encoded]), "<u4").astype(np.int64)
    a_last, b_last = align(np.cumsum(tokens.a_length[a]), np.cumsum(tokens.b_length[b]))
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_doc = np.repeat(np.arange(len(texts)), n_a)
    group_doc = a_doc[a_last]
    n_groups = np.bincount(group_doc, minlength=len(texts))
    total = np.bincount(a_group, minlength=len(group_doc)) * np.bincount(b_group, minlength=len(group_doc))
    bounds = np.append(0, np.cumsum(n_groups))
    n_links = np.append(0, np.cumsum(total))[bounds]
    data, ends = _joined_ids(a, b, a_last, b_last, a_group, b_group, bounds)
    view = memoryview(data)
    sha = [hashlib.sha256(view[x:y]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
    key, weight = links(a, b, a_group, b_group, group_doc, len(tokens.b_bytes))
    squeeze = zstandard.ZstdCompressor(level=1)
    # Sorted keys as differences; small numbers compress well.
    blob = squeeze.compress(np.diff(key, prepend=np.int64(0)).astype("<i8").tobytes())
    return {
        "doc_ids": doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.diff(n_links), "sha": sha,
        "keys": blob, "weights": squeeze.compress(weight.astype("<i8").tobytes()),
    }


_COLUMNS = ("doc_ids", "n_a", "n_b", "n_groups", "n_links")


def _aligned(rows: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    def task(batches):
        tokens = _loaded(a_json, b_model)
        for part in slices(batches, "text", SLICE_BYTES):
            row = _aligned_slice(tokens, part.column(0), part.column(1).to_pylist())
            longs = [pa.array([row[name].to_pylist() if name == "doc_ids" else row[name]], pa.list_(pa.int64())) for name in _COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array([row["sha"]]), pa.array([row["keys"]], pa.binary()), pa.array([row["weights"]], pa.binary())],
                [*_COLUMNS, "sha", "keys", "weights"],
            )

    listed = ", ".join(f"{name} array<long>" for name in _COLUMNS)
    return settle(rows.mapInArrow(task, f"{listed}, sha array<string>, keys binary, weights binary"))


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and pairs of a slice."""
    key = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8"))
    return key >> 32, key & 0xFFFFFFFF


def _pair_table(slices_: DataFrame, b_size: int) -> DataFrame:
    """Settled pair, n (documents that hold it linked) and best (whether its A id has no larger n)."""
    def task(batches):
        held, count, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        fresh = []

        def merged():
            keys, counts = zip((held, count), *fresh)
            return _counted(np.concatenate(keys), np.concatenate(counts))

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                fresh.append(_counted(_keys(blob)[1]))
                size += len(fresh[-1][0])
                if size > TABLE_PAIRS // 2:
                    (held, count), fresh, size = merged(), [], 0
                    if len(held) > TABLE_PAIRS // 2:
                        yield _pairs(held, count, b_size)
                        held, count = held[:0], count[:0]
        held, count = merged()
        yield _pairs(held, count, b_size)

    counted = slices_.select("keys").mapInArrow(task, "a long, pair long, n long").groupBy("a", "pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as B has entries.
    return settle(counted.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best")))


def _pairs(pair: np.ndarray, n: np.ndarray, b_size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair // b_size), pa.array(pair), pa.array(n)], ["a", "pair", "n"])


_TABLE: dict[str, tuple] = {}


def _blocks(files: list[str], keep: bool):
    """Pairs, counts and marks of each file of the table; a small table is kept by the worker."""
    for name in files:
        if name not in _TABLE:
            system, path = opened(name)
            table = pq.read_table(path, filesystem=system)
            block = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
            if not keep:
                yield block
                continue
            _TABLE[name] = block
        yield _TABLE[name]


def _looked_up(slices_: DataFrame, table: DataFrame) -> DataFrame:
    """One row per document."""
    files, keep = table.inputFiles(), table.count() <= TABLE_PAIRS

    def finish(rows):
        parsed = [_keys(row["keys"]) for row in rows]
        pairs = np.concatenate([pair for _, pair in parsed])
        distinct, where = np.unique(pairs, return_inverse=True)
        n, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for pair, count, mark in _blocks(files, keep):
            at = np.searchsorted(distinct, pair)
            hit = np.flatnonzero(at < len(distinct))
            hit = hit[distinct[at[hit]] == pair[hit]]
            n[at[hit]], best[at[hit]] = count[hit], mark[hit]
        start = 0
        for row, (doc, pair) in zip(rows, parsed):
            own = where[start : start + len(pair)]
            start += len(pair)
            weight = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["weights"]), "<i8")
            bounds = np.searchsorted(doc, np.arange(len(row["n_a"]) + 1))
            sums = [np.diff(np.append(0, np.cumsum(weight * value[own]))[bounds]) for value in (best, n)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(row[name], pa.int64()) for name in _COLUMNS), *map(pa.array, sums), pa.array(row["sha"], pa.string())],
                ["doc_id", *_COLUMNS[1:], "n_best", "count_sum", "groups_sha256"],
            )

    def task(batches):
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                rows += batch.slice(k, 1).to_pylist()
                size += sum(rows[-1]["n_links"])
                if size >= LOOKUP_PAIRS:
                    yield from finish(rows)
                    rows, size = [], 0
        if rows:
            yield from finish(rows)

    longs = ", ".join(f"{name} long" for name in ("doc_id", *_COLUMNS[1:], "n_best", "count_sum"))
    return slices_.mapInArrow(task, f"{longs}, groups_sha256 string")


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A encodes space and text, B the text, to which it adds the space itself; strings of special tokens are
    plain text. A text that is null or empty, or that one of the two does not give back byte by byte, has no
    tokens: zeros and an empty digest. A link joins an A and a B token of one group; the count of an id pair
    is the number of rows that hold it linked. n_best is the number of links whose pair has its A id's
    largest count, count_sum the sum of counts over the links. Rows that repeat an id or a text are rows of
    their own; ids are cast to long; an empty table gives no rows; other columns are ignored. The files are
    read on the driver and sent with the tasks.
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        a_json, b_model = a.read(), b.read()
    b_size = len(_loaded(a_json, b_model).b_bytes)
    if b_size * len(_loaded(a_json, b_model).a_bytes) >= 1 << 32:
        raise ValueError("the vocabularies have more than 2^32 id pairs")
    rows = narrow(df, doc_id=row_id, text=text).select(F.col("doc_id").cast("long"), "text")
    aligned = _aligned(rows, a_json, b_model)
    return _looked_up(aligned, _pair_table(aligned, b_size))
