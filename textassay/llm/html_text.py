"""Main text of HTML pages: block lines, structure, and differencing against the nearest page of the host.

On every page each line that the nearest page of the same host shares, in order, is taken for page furniture, unless that
page is a copy. Marks (``article`` or ``main``) check this: a shared line that both pages mark as article stays, and what a page
with a mark holds outside of it goes.
"""

from __future__ import annotations

import html
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.common import narrow, slices, task_number
from textassay.llm.urls import host_and_path
from textassay.session import broadcast_checked, settle

# Elements whose content is no text of the page.
DROPPED = frozenset("""
    script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas
    audio video menu dialog
""".split())
# Names and roles by which pages mark menus, notices, adverts and comments.
DROPPED_NAMES = frozenset("""
    ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies cookie-banner
    cookie-notice consent notice notices newsletter subscribe popup modal overlay sidebar side-bar menu nav navbar navigation
    breadcrumb breadcrumbs pagination footer header site-header site-footer page-header masthead comment comments comment-list
    comments-area disqus respond related related-posts recommended share sharing social social-share widget widgets
""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# Elements that begin and end a block.
BLOCKS = frozenset("""
    address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
# Pages that share this part of their lines are copies, which do not tell text from furniture.
COPY = 0.8
# One part of the order of pages holds about so many at most.
PART_PAGES = 1_000_000
ZONES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)


def _dropped(name: str, attributes: str, in_zone: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_zone):
        return True
    if not attributes or name in ("html", "body", *ZONES) and "comment" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        words = "".join(values).lower().split()
        key = key.lower()
        if key == "role" and not DROPPED_ROLES.isdisjoint(words) or key in ("class", "id") and not DROPPED_NAMES.isdisjoint(words):
            return True
        if key == "hidden" or key == "aria-hidden" and words == ["true"]:
            return True
    return False


def page_lines(page: str | None) -> tuple[list[str], list[bool]]:
    """Visible lines of a page, one per block, and whether each stands in an article or main element.

    Character references are decoded and white space in a block becomes one space. A
    dropped element that is never closed ends where an article or main element begins.
    """
    page = page or ""
    lines, zoned, parts = [], [], []
    zone, at, skip, depth = 0, 0, None, 0

    def finish():
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            lines.append(line)
            zoned.append(zone > 0)

    while True:
        mark = _MARK.search(page, at)
        if skip is None and (end := mark.start() if mark else len(page)) > at:
            parts.append(html.unescape(page[at:end]))
        if mark is None:
            break
        at = mark.end()
        name = (mark[2] or "").lower()
        if not name:
            continue
        closing = bool(mark[1])
        if skip is not None:
            if name == skip:
                depth += -1 if closing else 1
                if not depth:
                    skip = None
                continue
            if closing or name not in ZONES or zone:
                continue
            skip = None
        if not closing and name not in VOID and not mark[3].endswith("/") and _dropped(name, mark[3], zone > 0):
            if name in BLOCKS:
                finish()
            if name in RAW:
                closed = re.compile(f"</{name}[^>]*+>", re.I).search(page, at)
                at = closed.end() if closed else len(page)
            else:
                skip, depth = name, 1
        elif name in BLOCKS:
            finish()
            if name in ZONES:
                zone = max(0, zone + (-1 if closing else 1))
        elif name == "br":
            parts.append(" ")
    finish()
    return lines, zoned


def shared_lines(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which of our lines lie on a longest common subsequence with theirs; memory linear in both."""
    shared = np.zeros(len(ours), bool)

    def table(a, b):
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
            np.maximum.accumulate(row, out=row)
        return row

    pending = [(np.flatnonzero(np.isin(ours, theirs)), theirs[np.isin(theirs, ours)])]
    while pending:
        mine, other = pending.pop()
        if not len(mine) or not len(other):
            continue
        if len(mine) == 1:
            shared[mine[0]] |= bool((other == ours[mine[0]]).any())
            continue
        middle = len(mine) // 2
        head, tail = ours[mine[:middle]], ours[mine[middle:]]
        cut = int(np.argmax(table(head, other) + table(tail[::-1], other[::-1])[::-1]))
        pending += [(mine[:middle], other[:cut]), (mine[middle:], other[cut:])]
    return shared


def _parsed(df: DataFrame, row_id: str, url: str, page: str) -> DataFrame:
    """Row key, id, url, host, path, lines (of a page that marks its article those inside), hashes of all lines, bits of those inside."""
    def task(batches):
        number = task_number()
        for part in slices(batches, "html"):
            rows = []
            for address, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines, zoned = page_lines(text)
                marks = any(zoned)
                hashes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in lines], "<u8").tobytes()
                bits = np.packbits(np.array(zoned, bool)).tobytes()
                rows.append((*host_and_path(address), [x for x, z in zip(lines, zoned) if z or not marks], hashes, bits))
            host, path, lines, hashes, bits = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(number, number + len(rows)), pa.int64()), part.column(0), part.column(1), pa.array(host), pa.array(path),
                 pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.binary()), pa.array(bits, pa.binary())],
                ["row", "page_id", "url", "host", "path", "lines", "hashes", "marked"],
            )
            number += len(rows)

    rows = narrow(df, page_id=row_id, url=url, html=page)
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(
        task, f"row long, page_id {kind}, url string, host string, path string, lines array<string>, hashes binary, marked binary"
    )


def nearest_pages(pages: DataFrame) -> DataFrame:
    """Row, and the rows of its nearest page (``near``) and its second nearest (``next``).

    They are the two neighbours in order of host, path and id that are on the same host; the one whose path has
    more leading characters in common comes first, else the earlier. Pages of a host with equal lines are one
    page at the place of the first of them.

    The order is one range partitioning; neighbours across its borders come from the first and
    last row of each part, of which there is one pair per part.
    """
    order = ["host", "path", "page_id", "row"]
    same = F.sha2("hashes", 256).alias("same")
    keyed = pages.select(*order, same)
    firsts = settle(keyed.groupBy("host", "same").agg(F.min(F.struct("path", "page_id", "row")).alias("first")))
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(least, -(-firsts.count() // PART_PAGES))
    ordered = firsts.select("host", "first.*", "same").repartitionByRange(count, *order)
    keys = settle(ordered.withColumn("part", F.spark_partition_id()))
    key = F.struct("host", "path", "row")
    within = Window.partitionBy("part").orderBy(*order)
    near = keys.select("part", *order, "same", F.lag(key).over(within).alias("before"), F.lead(key).over(within).alias("after"))
    ends = keys.groupBy("part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    parts = Window.orderBy("part")
    edges = settle(ends.select("part", F.lag("last").over(parts).alias("last"), F.lead("first").over(parts).alias("first")))
    edge = lambda name: F.struct(*(F.col(f"{name}.{x}").alias(x) for x in ("host", "path", "row")))
    joined = near.join(broadcast_checked(edges), "part", "left").select(
        "same", "host", "path", F.coalesce("before", F.when(F.col("last").isNotNull(), edge("last"))).alias("before"),
        F.coalesce("after", F.when(F.col("first").isNotNull(), edge("first"))).alias("after"),
    )

    @F.pandas_udf("boolean")
    def after_is_nearer(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        common = lambda a, b: -1 if b is None else len(os.path.commonprefix([a, b]))
        return pd.Series([common(p, a) > common(p, b) for p, b, a in zip(path, before, after)], dtype=bool)

    path = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.col(f"{side}.path"))
    row = lambda side: F.when(F.col(side).isNotNull(), F.col({"b": "before", "a": "after"}[side])["row"])
    marked = joined.withColumns({"b": path("before"), "a": path("after")}).withColumn("later", after_is_nearer("path", "b", "a"))
    found = marked.select(
        "host", "same", F.when(F.col("later"), row("a")).otherwise(row("b")).alias("near"),
        F.when(F.col("later"), row("b")).otherwise(row("a")).alias("next"),
    )
    return keyed.join(settle(found), ["host", "same"]).select("row", "near", "next")


def furniture(ours: tuple[np.ndarray, np.ndarray], *others: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which of our lines the first of the ``others`` shares that has lines and is no copy, but for those both mark as article.

    A page is the hashes of its lines and whether it marks each. Two pages are copies if at least ``COPY`` of the lines of
    both lie on their longest common subsequence.
    """
    lines, marked = ours
    for other in others:
        if other is None or not len(other[0]):
            continue
        shared = shared_lines(lines, other[0])
        if 2 * shared.sum() < COPY * (len(lines) + len(other[0])):
            return shared & ~(marked & np.isin(lines, other[0][other[1]]))
    return np.zeros(len(lines), bool)


def _furniture_rows(pages: DataFrame) -> DataFrame:
    """``row`` and ``gone`` of the pages that lose lines: a byte for each of ``lines``, 1 if it is furniture."""
    near = settle(nearest_pages(pages).filter("near is not null"))
    joined = pages.select("row", "hashes", "marked").join(near, "row")
    # Pages without a second neighbour get keys that no page has, a different one each.
    joined = joined.withColumn("next", F.coalesce("next", -1 - F.col("row")))
    for name, side in (("near", "first"), ("next", "second")):
        theirs = pages.select(F.col("row").alias(name), F.struct("hashes", "marked").alias(side))
        joined = joined.join(theirs, name, "left")
    joined = joined.select("row", F.struct("hashes", "marked").alias("own"), "first", "second")

    def task(batches):
        def read(side):
            if side is None:
                return None
            lines = np.frombuffer(side["hashes"], "<u8")
            return lines, np.unpackbits(np.frombuffer(side["marked"], np.uint8), count=len(lines)).astype(bool)

        for batch in batches:
            rows, masks = [], []
            for row, *sides in zip(*(column.to_pylist() for column in batch.columns)):
                own, first, second = map(read, sides)
                gone = furniture(own, first, second)
                if own[1].any():
                    gone = gone[own[1]]
                if gone.any():
                    rows.append(row)
                    masks.append(gone.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(masks, pa.binary())], ["row", "gone"])

    return settle(joined.mapInArrow(task, "row long, gone binary"))


def main_text(df: DataFrame, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``df``: page_id, url, text (lines joined by a newline, empty if none), n_chars.

    Null and empty pages have no text. Pages without a host (null URL or none in it) count as one
    host. A page alone on its host keeps all lines within its mark, if it has one, and so does one whose two nearest pages
    are copies of it: a copy does not tell text from furniture. Repeated rows give a row each. Other columns are ignored.
    """
    pages = settle(_parsed(df, row_id, url, page))
    joined = pages.select("row", "page_id", "url", "lines").join(broadcast_checked(_furniture_rows(pages)), "row", "left")
    stays = F.filter("lines", lambda _, k: F.substring("gone", k + 1, 1) == F.lit(bytearray(1)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stays), "\n")
    return joined.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
