"""URL filters: a trie over reversed host labels and path text, broadcast; the longest entry wins."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import ship

# The trie is sent to every executor, so the list is bounded.
MAX_RULES = 1_000_000
_SCHEME = re.compile("://")
_HOST_END = re.compile("[/?#]")
_PATH_END = re.compile("[?#]")
_UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    found = _SCHEME.search(url or "")
    if not found:
        return "", ""
    rest = url[found.end():]
    cut = _HOST_END.search(rest)
    host, rest = (rest[: cut.start()], rest[cut.start():]) if cut else (rest, "")
    cut = _PATH_END.search(rest)
    return host.translate(_UPPER), rest[: cut.start()] if cut else rest


class Trie:
    """Allow and block entries ``(verdict, host, path)``.

    Hosts branch by label from the right. Each host node has a second trie over the
    path's segments; an entry's last segment may end inside a segment of the URL.
    The entry with most host labels wins, then the longest path; of an allow and a
    block entry with the same host and path the block entry wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        count = 0
        for verdict, host, path in rules:
            count += 1
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} entries: they are broadcast")
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            host = host.translate(_UPPER)
            node = self.root
            for label in reversed(host.split(".") if host else []):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, ("", ""))[0] != "block":
                ends[last] = (verdict, host + path)
            node["lengths"] = sorted({len(x) for x in ends}, reverse=True)

    @staticmethod
    def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for length in node.get("lengths", ()):
                if (hit := node["ends"].get(segment[:length])) and len(segment) >= length:
                    best = hit
                    break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """``(verdict, rule)`` of the winning entry, or None."""
        segments = path.split("/")
        node, best = self.root, None
        for label in (None, *reversed(host.split(".") if host else [])):
            if label is not None:
                node = node.get("labels", {}).get(label)
                if node is None:
                    break
            if "paths" in node:
                best = self._longest_path(node["paths"], segments) or best
        return best


def filter_urls(
    df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """``df`` with host, path, rule and verdict for each row; own columns of these names are replaced.

    A URL that no entry fits, a null one, an empty one or one without ``://`` gets
    rule null and the ``default`` verdict (an entry with empty host and empty path
    fits all URLs). Rows are kept as they are, repeated ones too.
    """
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        out = []
        for value in urls:
            host, path = host_and_path(value)
            verdict, rule = trie.value.longest(host, path) or (default, None)
            out.append((host, path, rule, verdict))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    names = ("host", "path", "rule", "verdict")
    own = "_judged"
    while own in df.columns:
        own += "_"
    kept = df.withColumn(own, judged(F.col(f"`{url}`")))
    return kept.withColumns({name: F.col(f"{own}.{name}") for name in names}).drop(own)
