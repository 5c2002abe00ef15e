"""Byte-level BPE by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textassay.llm.common import narrow, slices

# Pieces of text that a task remembers with their ids; the memory of a worker is bounded.
PIECE_MEMORY = 300_000
# Longer pieces are not remembered.
PIECE_BYTES = 64


class Encoder:
    """Exact BPE of a rank list in time linear in the text.

    ``ranks`` maps a token's bytes to its id; a smaller id merges earlier, and every
    single byte is a token. The encoder walks the text with the longest token at each
    place. A token may follow another only if BPE would leave the border between the
    two alone; that answer is remembered per pair. Where none may follow, the walk
    takes the last token back and tries its next shorter prefix.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, i)
                if len(parts) == 2:
                    self.halves[i] = parts
                    self.whole[parts] = i

    def _merged(self, token: bytes, limit: int) -> tuple[int, ...]:
        """Ids of a token's bytes after all merges that come before it."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[k] + parts[k + 1], limit), k) for k in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            text = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ranks), None)
        return self.shorter[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes ends with just these two tokens."""
        key = (left, right)
        if key not in self.compatible:
            if len(self.compatible) > 4_000_000:
                self.compatible.clear()
            self.compatible[key] = self._border_holds(left, right)
        return self.compatible[key]

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' merges step by step. The tokens at the border
        # must not have a merge that comes before the merge that took one of them away.
        limit = 1 << 62
        while True:
            if self.whole.get((left, right), limit) < limit:
                return False
            split_left = left in self.halves and (left > right or right not in self.halves)
            if split_left:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                # The left one of equal merges comes first, so this one may still tie.
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece; a piece that is itself a token is that token."""
        if not piece:
            return []
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        size = len(piece)
        longest: list[int | None] = [None] * size
        span = [0] * size
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > span[start]:
                span[start], longest[start] = length, token
        open_end = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.bytes_of[token])
                if open_end[end] and (last is None or self._fits(last, token)):
                    break
                token = self._prefix(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < size else None
            else:
                if last is None:
                    raise ValueError("the rank list lacks a single byte")
                open_end[at] = 0
                out.pop()
                at -= len(self.bytes_of[last])
                token = self._prefix(last)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers, worked out when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= PIECE_BYTES:
            if len(self) >= PIECE_MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Splits whole texts by ``pattern`` and encodes each match by itself."""

    def __init__(self, path: str, pattern: str):
        self.encoder, self.pattern = Encoder(read_ranks(path)), regex.compile(pattern)
        self.pieces = _Pieces(self.encoder)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return self.encoder.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker; tasks that follow one another share its pieces."""
    return TextEncoder(path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int).

    Null and empty texts have no ids. Rows are independent: repeated rows and null ids
    give a row each. Only the two named columns are read.
    """
    def task(batches):
        encoder = loaded(ranks_path, pattern)
        for part in slices(batches, "text", 1 << 20):
            ids = [encoder.encode(x) for x in part.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["doc_id", "ids"])

    rows = narrow(df, doc_id=row_id, text=text)
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, row_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per document: doc_id, content (the bytes the ids stand for). Null: empty."""
    def task(batches):
        table = {i: t for t, i in read_ranks(ranks_path).items()}
        for batch in batches:
            content = [b"".join(map(table.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    rows = narrow(df, doc_id=row_id, ids=ids)
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def digests(df: DataFrame, ranks_path: str, pattern: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one task: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers. Cases as in ``encode``.
    """
    def task(batches):
        encoder = loaded(ranks_path, pattern)
        for part in slices(batches, "text", 1 << 20):
            count, of_ids, of_bytes = [], [], []
            for value in part.column(1).to_pylist():
                ids = encoder.encode(value)
                count.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = narrow(df, doc_id=row_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
