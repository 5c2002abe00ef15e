"""Benchmark decontamination: a positional inverted index of the training texts, searched for
exact phrases and for words close together.

The index is cut into segments of whole documents. A segment is one row: its terms (64-bit
word hashes), and for each the ascending positions at which it stands. Test windows are
looked up segment by segment: the postings of a window's rarest term, moved back by the
term's place in the window, are candidates for the window's start; they are intersected with
the moved postings of the next rarest term, and so on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import LOWER, WORD, flat, hashes, narrow, runs, slices, task_number
from textassay.session import LARGE_ROWS, settle

WINDOW = 10
# Text of one segment of the index; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
# Windows searched for at a time; what is broadcast is at most this many windows with their item.
BLOCK_WINDOWS = 50_000
# Candidates that a task holds at a time.
CANDIDATES = 1 << 20
_LOWER = np.frombuffer(LOWER, np.uint8)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the n + 1 bounds of each text's words."""
    data, offsets = flat(column)
    data = _LOWER[data]
    starts, ends = runs(WORD[data], offsets)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window): ``window`` consecutive word hashes as bytes.

    An item with fewer words, but not none, is one shorter window; null and blank items have none.
    """
    def task(batches):
        for part in slices(batches, "text"):
            terms, bounds = words(part.column(1))
            row, blobs = [], []
            for k in range(part.num_rows):
                own = terms[bounds[k] : bounds[k + 1]]
                for start in range(max(1, len(own) - window + 1) if len(own) else 0):
                    row.append(k)
                    blobs.append(own[start : start + window].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(blobs, pa.binary())], ["item_id", "window"])

    rows = narrow(items, item_id=item_id, text=text)
    return rows.mapInArrow(task, f"item_id {rows.schema['item_id'].dataType.simpleString()}, window binary").distinct()


def build_index(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the positional index, written to the shared folder.

    Columns: segment, doc_ids (array), bounds (first word position of each document and the
    end), terms (ascending), term_bounds, positions (ascending per term), all little-endian.
    Null and empty texts are documents without words.
    """
    def blobs(part):
        of_word, bounds = words(part.column(1))
        order = np.argsort(of_word, kind="stable")
        ordered = of_word[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        found = bounds.astype("<i8"), ordered[first].astype("<u8"), np.append(first, len(ordered)).astype("<u4"), order.astype("<u4")
        return [pa.array([x.tobytes()], pa.binary()) for x in found]

    def task(batches):
        number = task_number()
        for part in slices(batches, "text", SEGMENT_BYTES):
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), ids, *blobs(part)], ["segment", "doc_ids", "bounds", "terms", "term_bounds", "positions"],
            )
            number += 1

    rows = narrow(df, doc_id=row_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return settle(rows.mapInArrow(
        task, f"segment long, doc_ids array<{kind}>, bounds binary, terms binary, term_bounds binary, positions binary"
    ), LARGE_ROWS)


def documents(index: DataFrame) -> DataFrame:
    """One row per indexed document: segment, place (in the segment), doc_id, n_words."""
    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                n = np.diff(np.frombuffer(batch.column(2)[k].as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), batch.column(0)[k].as_py(), np.int64)), pa.array(np.arange(len(n))), ids, pa.array(n)],
                    ["segment", "place", "doc_id", "n_words"],
                )

    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.select("segment", "doc_ids", "bounds").mapInArrow(task, f"segment long, place long, doc_id {kind}, n_words long")


class _Segment:
    def __init__(self, bounds: bytes, terms: bytes, term_bounds: bytes, positions: bytes):
        self.bounds = np.frombuffer(bounds, "<i8")
        self.terms = np.frombuffer(terms, "<u8")
        self.term_bounds = np.frombuffer(term_bounds, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.term_bounds)) << 32) | self.positions

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting between ``low`` and ``high``."""
        at = np.searchsorted(self.keys, (term << 32) | low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (low <= high) & (found <= ((term << 32) | np.maximum(high, 0)))


class _Block:
    """Windows of one block: term matrix, lengths, and places from the rarest term on."""

    def __init__(self, windows: list[bytes], items: list, frequency: dict[int, int]):
        self.items = items
        self.lengths = np.array([len(x) // 8 for x in windows])
        width = int(self.lengths.max())
        self.terms = np.zeros((len(windows), width), np.uint64)
        for k, blob in enumerate(windows):
            self.terms[k, : self.lengths[k]] = np.frombuffer(blob, "<u8")
        self.used = np.arange(width) < self.lengths[:, None]
        self.repeats = np.array([len(np.unique(row[:n])) < n for row, n in zip(self.terms, self.lengths)])
        vocabulary, inverse = np.unique(self.terms, return_inverse=True)
        count = np.array([frequency.get(int(x), 0) for x in vocabulary], np.int64)[inverse.reshape(self.terms.shape)]
        self.order = np.argsort(np.where(self.used, count, np.iinfo(np.int64).max), axis=1, kind="stable")

    def search(self, segment: _Segment, slop: int):
        """Yields arrays (window, document place, start) of all occurrences."""
        if not len(segment.terms):
            return
        at = np.minimum(np.searchsorted(segment.terms, self.terms), len(segment.terms) - 1)
        alive = np.flatnonzero(((segment.terms[at] == self.terms) | ~self.used).all(axis=1))
        if not len(alive):
            return
        rarest = at[alive, self.order[alive, 0]]
        cost = segment.term_bounds[rarest + 1] - segment.term_bounds[rarest]
        ends = np.cumsum(cost)
        start = base = 0
        while start < len(alive):
            stop = max(start + 1, int(np.searchsorted(ends, base + CANDIDATES, "right")))
            yield self._search(segment, at, alive[start:stop], cost[start:stop], slop)
            start, base = stop, ends[stop - 1]

    def _search(self, segment: _Segment, at: np.ndarray, alive: np.ndarray, cost: np.ndarray, slop: int):
        window = np.repeat(alive, cost)
        place = np.arange(len(window)) - np.repeat(np.cumsum(cost) - cost, cost)
        offset = self.order[window, 0]
        position = segment.positions[segment.term_bounds[at[window, offset]] + place]
        doc = np.searchsorted(segment.bounds, position, "right") - 1
        start = position - offset
        for n in range(1, self.terms.shape[1]):
            offset = self.order[window, n]
            low = np.maximum(start + offset - slop, segment.bounds[doc])
            high = np.minimum(start + offset + slop, segment.bounds[doc + 1] - 1)
            keep = ~self.used[window, offset] | segment.holds(at[window, offset], low, high)
            window, doc, start = window[keep], doc[keep], start[keep]
            if not len(window):
                break
        if slop and len(window):
            keep = np.ones(len(window), bool)
            for k in np.flatnonzero(self.repeats[window]):
                keep[k] = self._distinct(segment, at[window[k]], window[k], doc[k], start[k], slop)
            window, doc, start = window[keep], doc[keep], start[keep]
        return window, doc, start - segment.bounds[doc]

    def _distinct(self, segment: _Segment, at: np.ndarray, window: int, doc: int, start: int, slop: int) -> bool:
        """Whether a word that the window repeats has a place of its own for each time.

        Ranges of equal width are served from the left; the rarest word's place is fixed.
        """
        rarest = self.order[window, 0]
        fixed, last = start + rarest, {}
        for offset in range(self.lengths[window]):
            if offset == rarest:
                continue
            term = at[offset]
            places = segment.positions[segment.term_bounds[term] : segment.term_bounds[term + 1]]
            low = max(start + offset - slop, segment.bounds[doc], last.get(term, -1) + 1)
            k = np.searchsorted(places, low)
            if term == at[rarest] and k < len(places) and places[k] == fixed:
                k += 1
            if k == len(places) or places[k] > min(start + offset + slop, segment.bounds[doc + 1] - 1):
                return False
            last[term] = places[k]
        return True


def _blocks(index: DataFrame, windows: DataFrame, block_windows: int):
    """Broadcast blocks of windows, each bounded by ``block_windows`` on average of a hash."""
    spark = index.sparkSession
    windows = settle(windows)
    count = -(-windows.count() // block_windows)
    for number in range(count):
        own = windows.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(count)) == number).collect()
        if not own:
            continue
        blobs, items = [bytes(row["window"]) for row in own], [row["item_id"] for row in own]
        wanted = spark.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(blobs), "<u8")))

        def counted(batches, wanted=wanted):
            total = np.zeros(len(wanted.value), np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    terms = np.frombuffer(batch.column(0)[k].as_py(), "<u8")
                    n = np.diff(np.frombuffer(batch.column(1)[k].as_py(), "<u4").astype(np.int64))
                    _, a, b = np.intersect1d(wanted.value, terms, True, return_indices=True)
                    total[a] += n[b]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

        rows = index.select("terms", "term_bounds").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        frequency = {int(wanted.value[row["term"]]): row["n"] for row in rows.collect()}
        yield spark.sparkContext.broadcast(_Block(blobs, items, frequency))


def _found(index: DataFrame, windows: DataFrame, slop: int, report, schema: str, block_windows: int) -> DataFrame:
    """Union over the blocks of ``report(segment number, doc ids, block, hits)``'s record batches."""
    columns = ("segment", "doc_ids", "bounds", "terms", "term_bounds", "positions")
    out = None
    for block in _blocks(index, windows, block_windows):
        def task(batches, block=block):
            for batch in batches:
                for k in range(batch.num_rows):
                    segment = _Segment(*(batch.column(c)[k].as_py() for c in range(2, 6)))
                    hits = [x for x in block.value.search(segment, slop) if len(x[0])]
                    if hits:
                        yield report(batch.column(0)[k].as_py(), batch.column(1)[k].values, block.value, *map(np.concatenate, zip(*hits)))

        part = index.select(*columns).mapInArrow(task, schema)
        out = part if out is None else out.unionByName(part)
    return index.sparkSession.createDataFrame([], schema) if out is None else out


def matches(index: DataFrame, windows: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All matches of all windows: doc_id, item_id, start (word number in the document), n_words.

    With ``slop`` 0 these are exact phrases. Otherwise each word of the window stands at
    most ``slop`` words from where the phrase would have it, counted from a window's rarest
    word, and no two words of the window on the same place; ``start`` is then the place the phrase would begin at and may be negative.
    """
    ids = index.schema["doc_ids"].dataType.elementType.simpleString()
    items = windows.schema["item_id"].dataType.simpleString()

    def report(_, doc_ids, block, window, doc, start):
        item = pa.array([block.items[k] for k in window.tolist()], ITEM_TYPE)
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(doc)), item, pa.array(start), pa.array(block.lengths[window])], ["doc_id", "item_id", "start", "n_words"]
        )

    ITEM_TYPE = _arrow_type(windows)
    return _found(index, windows, slop, report, f"doc_id {ids}, item_id {items}, start long, n_words long", block_windows)


def _arrow_type(windows: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(windows.schema["item_id"].dataType)


def contamination(
    df: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    A word inside any occurrence of any item's window is hit; item_ids are the items with
    occurring windows, in order of their ids as strings. Null, empty and blank texts have no
    words; no benchmark, no hits. Repeated rows and null doc_ids give a row each; an item with
    a null id hits words but is not listed. Other columns are ignored.
    """
    index = build_index(df, row_id, text)
    windows = test_windows(items, item_id, item_text, window)
    arrow_type = _arrow_type(windows)

    def report(number, _, block, window, doc, start):
        end = start + block.lengths[window]
        order = np.lexsort((start, doc))
        window, doc, start, end = window[order], doc[order], start[order], end[order]
        rows = []
        for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
            spans, last = [], -1
            for a, b in zip(start[at].tolist(), end[at].tolist()):
                if a <= last:
                    spans[-1]["b"] = last = max(last, b)
                else:
                    spans.append({"a": a, "b": b})
                    last = b
            own = dict.fromkeys(block.items[k] for k in window[at].tolist())
            rows.append((int(doc[at[0]]), spans, [x for x in own if x is not None]))
        place, spans, own = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(rows), pa.int64()), pa.array(place, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(own, pa.list_(arrow_type))],
            ["segment", "place", "spans", "items"],
        )

    kind = windows.schema["item_id"].dataType.simpleString()
    found = _found(index, windows, 0, report, f"segment long, place long, spans array<struct<a:long,b:long>>, items array<{kind}>", block_windows)
    merged = found.groupBy("segment", "place").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items"))), lambda x: x.cast("string"))).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate("spans", zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")
    ))["n"]
    hit = merged.select("segment", "place", n_hit.alias("n_hit"), "item_ids")
    return documents(index).join(hit, ["segment", "place"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
