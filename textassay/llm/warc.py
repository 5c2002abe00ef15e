"""WARC archives: written with an index of every record, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import narrow, slices
from textassay.llm.files import Output, new_folder, opened
from textassay.session import broadcast_checked, settle

ARCHIVE_BYTES = 256 << 20
# Records whose gap is at most this far apart are read together, up to the second bound.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
TASK_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_LEVEL = 4


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _id_value(value) -> str:
    """An id as it stands in a header: whatever could end the line is percent-encoded, and the percent sign."""
    return quote(str(value), safe="-_.~:/ ")


def _header_value(value) -> str:
    """Text that stays on one header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member with a response or revisit record; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url)}" if url is not None else None,
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Refers-To: {_record_id(refers_to)}" if refers_to is not None else None,
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to is not None else None,
        f"X-Page-ID: {_id_value(page_id)}" if page_id is not None else None,
        f"X-Refers-To-Page-ID: {_id_value(refers_to)}" if refers_to is not None else None,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    head = "\r\n".join(x for x in lines if x is not None).encode() + b"\r\n\r\n"
    squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(
    df: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, folder: str | None = None
) -> DataFrame:
    """Write one record per row and return the index: file, offset, length, page_id, url, digest, record_type.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest
    page_id are responses and the others revisit it. A null page is an empty payload; a null
    URL leaves the header out; rows with a null page_id are responses. Rows that repeat an id
    are written once each. The index is settled: it names what committed tasks have written.
    """
    folder = folder or new_folder(df.sparkSession, "warc")
    pages = narrow(df, page_id=row_id, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("same", F.sha2("html", 256))
    ids = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", "same")
    firsts = ids.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = settle(ids.join(firsts, "same").filter("page_id > refers_to").distinct())
    marked = pages.join(broadcast_checked(copies), ["page_id", "same"], "left").select("page_id", "url", "html", "refers_to")

    def task(batches):
        out = None
        for part in slices(batches, "html"):
            rows = []
            ids, urls, texts, refers = (column.to_pylist() for column in part.columns)
            for page_id, address, text, first in zip(ids, urls, texts, refers):
                payload = text.encode()
                digest = payload_digest(payload)
                blob = record(page_id, address, payload, digest, first)
                if out is not None and out.size + len(blob) > ARCHIVE_BYTES:
                    out.close()
                    out = None
                out = out or Output(folder, ".warc.gz")
                rows.append((out.name, out.append(blob), len(blob), digest, "response" if first is None else "revisit"))
            file, offset, length, digest, kind = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), part.column(0), part.column(1),
                 pa.array(digest), pa.array(kind)],
                ["file", "offset", "length", "page_id", "url", "digest", "record_type"],
            )
        if out is not None:
            out.close()

    kind = marked.schema["page_id"].dataType.simpleString()
    return settle(marked.mapInArrow(
        task, f"file string, offset long, length long, page_id {kind}, url string, digest string, record_type string"
    ))


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that an index, or any selection of its rows, names.

    Rows are put in order of file and offset; neighbours become one read of a byte range.
    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits). Control characters of a URL come back percent-encoded, ids as they were.
    A payload that does not have its digest is an error.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(-(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, max(1, total >> 20)))
    kind = index.schema["page_id"].dataType.simpleString()
    ordered = index.select("file", "offset", "length").repartitionByRange(int(parts), "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(batches):
        """Lists of (file, offset, length) that one read covers."""
        run, end = [], 0
        for batch in batches:
            for file, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                if run and (file != run[0][0] or offset - end > GAP_BYTES or offset + length - run[0][1] > RANGE_BYTES):
                    yield run
                    run = []
                run.append((file, offset, length))
                end = offset + length
        if run:
            yield run

    def task(batches):
        name = source = None
        for run in ranges(batches):
            if run[0][0] != name:
                name = run[0][0]
                system, path = opened(name)
                source = system.open_input_file(path)
            base = run[0][1]
            source.seek(base)
            data = source.read(run[-1][1] + run[-1][2] - base)
            rows = []
            for _, offset, length in run:
                fields, http, payload = parse(data[offset - base : offset - base + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if response and payload_digest(payload) != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                page_id, refers = (None if x is None else unquote(x) for x in map(fields.get, ("X-Page-ID", "X-Refers-To-Page-ID")))
                rows.append((
                    page_id, fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, fields["WARC-Type"],
                    refers, payload if response else None,
                ))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    found = ordered.mapInArrow(
        task, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
