"""Token ids in binary files: each document a zstandard frame of its own under a shared dictionary.

A file holds the frames of its documents one after another, then the index (frame ends, id
counts, doc ids, null flags), then a trailer of fixed size with magic, bytes per id, dictionary
hash, number of documents and the place of the index. The dictionary is a file beside them.
One document is read with the trailer, the index and its frame alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.common import narrow, slices
from textassay.llm.files import Output, new_folder, opened
from textassay.session import settle

END_ID = 0
DICTIONARY_BYTES = 64 << 10
# The dictionary is trained on at most this many documents of at most this many characters.
TRAINING_DOCUMENTS = 512
TRAINING_CHARS = 16_384
PARTITION_BYTES = 64 << 20
FILE_BYTES = 128 << 20
# Pieces a worker remembers with their ids, about 200 bytes each.
PIECE_MEMORY = 1_400_000
PIECE_CHARS = 64
_LEVEL = 3
_TRAILER = struct.Struct("<8sI32sQQ")
_MAGIC = b"IDSHARD1"
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


class Tokens:
    """Ids of whole texts from the tokenizers library as it is loaded; none are put around a text.

    A byte-level pre-tokenizer with its usual pattern always cuts before a single space that
    stands between two characters that are not white space. Texts are cut there, and each
    distinct piece is encoded once and remembered. Texts with other white space around a
    space, texts that hold the content of an added token, and other kinds of tokenizers, go to
    the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as source:
            parts = json.load(source)
        split = parts.get("pre_tokenizer") or {}
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and parts.get("normalizer") is None and parts.get("post_processor") is None
        )
        # An added token is found before texts are cut, so texts that may hold one are not cut.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.pieces: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        """Pieces of a text; the first, which no space precedes, is marked by a line feed."""
        parts = text.split(" ") if self.cuts and not any(x in text for x in self.added) else [text]
        if len(parts) > 1 and ("" in parts or any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACES)):
            parts = [text]
        parts[0] = "\n" + parts[0]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers."""
        known = self.pieces
        if len(known) > PIECE_MEMORY:
            # Frequent pieces come early, so the later half goes.
            for piece in list(islice(known, PIECE_MEMORY // 2, None)):
                del known[piece]
        cut = list(map(self._parts, texts))
        fresh = list(set(chain.from_iterable(cut)).difference(known))
        encoded = self.tokenizer.encode_batch_fast([x[1:] if x[0] == "\n" else " " + x for x in fresh], add_special_tokens=False)
        known.update(zip(fresh, (np.array(x.ids, self.kind).tobytes() for x in encoded)))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for piece in fresh:
            if len(piece) > PIECE_CHARS:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Tokens:
    """One tokenizer per worker; tasks that follow one another share its pieces."""
    return Tokens(path)


def train_dictionary(df: DataFrame, tokenizer_path: str, row_id: str = "doc_id", text: str = "text") -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; empty if the sample is too small.

    The sample is ``TRAINING_DOCUMENTS`` documents with the smallest hash of their text, of those with
    1 to ``TRAINING_CHARS`` characters. Which they are changes sizes of files, never what is read back.
    """
    rows = narrow(df, doc_id=row_id, text=text).filter(F.char_length("text").between(1, TRAINING_CHARS))
    sample = rows.select("text", F.xxhash64("text", "doc_id").alias("place")).orderBy("place").limit(TRAINING_DOCUMENTS)

    def task(batches):
        tokens = loaded(tokenizer_path)
        samples = [ids for batch in batches for ids in tokens.encode(batch.column(0).to_pylist())]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b""
        except zstandard.ZstdError:  # too little text to train on
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], ["dictionary"])

    trained = [bytes(row[0]) for row in sample.select("text").coalesce(1).mapInArrow(task, "dictionary binary").collect()]
    return max(trained, key=len, default=b"")


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


class _Writer:
    def __init__(self, folder: str, kind: str, dictionary: bytes):
        self.out = Output(folder, ".ids")
        self.kind, self.digest = kind, hashlib.sha256(dictionary).digest()
        self.ends, self.counts, self.ids = [], [], []

    def append(self, doc_id, frame: bytes, n_ids: int) -> None:
        self.out.append(frame)
        self.ends.append(self.out.size)
        self.counts.append(n_ids)
        self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        place = self.out.size
        index = (np.array(self.ends, "<u8"), np.array(self.counts, "<u8"), np.array([x or 0 for x in self.ids], "<i8"),
                 np.array([x is None for x in self.ids], "u1"))
        for array in index:
            self.out.append(array.tobytes())
        self.out.append(_TRAILER.pack(_MAGIC, int(self.kind[2]), self.digest, len(self.ids), place))
        self.out.close()
        return self.out.name, len(self.ids), sum(self.counts)


def write_ids(df: DataFrame, tokenizer_path: str, row_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order and return the settled list of files.

    Columns: part, piece (files in this order hold ascending ids), file, n_docs, n_ids,
    dictionary (its file). Each document's ids are followed by ``END_ID``. Null and empty texts
    are that id alone. Null doc_ids come first; documents that repeat an id are all kept, in
    order of a hash of their text. doc_id must be an integer column.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "ids")
    rows = narrow(df, doc_id=row_id, text=text)
    if rows.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer column")
    dictionary = train_dictionary(df, tokenizer_path, row_id, text)
    name = f"{folder}/dictionary"
    system, path = opened(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(dictionary)
    rows = rows.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(-(-size // PARTITION_BYTES), min(spark.sparkContext.defaultParallelism * 4, max(1, size >> 20))))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def task(batches):
        tokens = loaded(tokenizer_path)
        squeeze = zstandard.ZstdCompressor(level=_LEVEL, **_dictionary(dictionary))
        end = np.array([END_ID], tokens.kind).tobytes()
        writer, files = None, []
        for part in slices(batches, "text", 1 << 20):
            for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode([x or "" for x in part.column(1).to_pylist()])):
                if writer is not None and writer.out.size > FILE_BYTES:
                    files.append(writer.close())
                    writer = None
                writer = writer or _Writer(folder, tokens.kind, dictionary)
                ids += end
                writer.append(doc_id, squeeze.compress(ids), len(ids) // len(end))
        if writer is not None:
            files.append(writer.close())
        if files:
            number = TaskContext.get().partitionId()
            file, n_docs, n_ids = zip(*files)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(files), pa.int64()), pa.array(range(len(files)), pa.int64()), pa.array(file),
                 pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64()), pa.array([name] * len(files))],
                ["part", "piece", "file", "n_docs", "n_ids", "dictionary"],
            )

    return settle(ordered.mapInArrow(task, "part long, piece long, file string, n_docs long, n_ids long, dictionary string"))


class Reader:
    """One file of ids: its index, and any document by its number in the file."""

    def __init__(self, file: str, dictionary: str):
        system, path = opened(dictionary)
        with system.open_input_file(path) as source:
            data = source.read()
        system, path = opened(file)
        self.source = system.open_input_file(path)
        size = self.source.size()
        magic, width, digest, n, place = _TRAILER.unpack(self.source.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError(f"{file} is no file of ids")
        if digest != hashlib.sha256(data).digest():
            raise ValueError(f"{file} was written with another dictionary")
        index = self.source.read_at(size - _TRAILER.size - place, place)
        self.kind = f"<u{width}"
        self.ends = np.frombuffer(index, "<u8", n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n, 16 * n)
        self.null = np.frombuffer(index, "u1", n, 24 * n).astype(bool)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if n else self.ends
        self.expand = zstandard.ZstdDecompressor(**_dictionary(data))

    def document(self, number: int, frames: bytes | None = None, base: int = 0) -> np.ndarray:
        """Ids of the document with this number; ``frames`` are bytes already read from ``base`` on."""
        start, end = int(self.starts[number]), int(self.ends[number])
        frame = self.source.read_at(end - start, start) if frames is None else frames[start - base : end - base]
        return np.frombuffer(self.expand.decompress(frame), self.kind)

    def all(self, read_bytes: int = 8 << 20):
        """Numbers and ids of all documents, read in large pieces."""
        number = 0
        while number < len(self.ends):
            base = int(self.starts[number])
            stop = max(number + 1, int(np.searchsorted(self.ends, base + read_bytes, "right")))
            frames = self.source.read_at(int(self.ends[stop - 1]) - base, base)
            for k in range(number, stop):
                yield k, self.document(k, frames, base)
            number = stop


def read_ids(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    n_tokens counts the end id; the checksum is over the ids as little-endian unsigned 32-bit integers.
    The running total is over one short row per file.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("file", "dictionary", F.coalesce(before, F.lit(0)).alias("start"))
    placed = settle(placed)
    spread = placed.repartition(int(max(1, placed.count())), "file")

    def task(batches):
        for batch in batches:
            for file, dictionary, start in zip(*(column.to_pylist() for column in batch.columns)):
                reader = Reader(file, dictionary)
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.all()]
                starts = start + np.cumsum(reader.counts) - reader.counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, mask=reader.null), pa.array(starts, pa.int64()), pa.array(reader.counts, pa.int64()),
                     pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spread.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
