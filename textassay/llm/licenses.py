"""License scans: notices and license texts found in documents by patience alignment."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.common import mix, narrow, slices
from textassay.llm.license_texts import TEMPLATES, Template
from textassay.llm.phrases import words
from textassay.llm.suffix import contained

COVERAGE = 0.8
# Templates are sent to every executor, so their number is bounded.
MAX_TEMPLATES = 10_000

# Words that on their own say nothing about a license.
STOP_WORDS = "a an and any are as at be by for from in is it of on or that the this to with".split()
# Words that turn a notice into its opposite.
NEGATIONS = "not never neither nor isn aren wasn".split()
# Texts below this many words are notices; a negation inside, or so many words before, rules them out.
NOTICE_WORDS = 20
NEGATION_REACH = 3
# A region needs one in ten of the template's pairs of words to be aligned.
PAIRS_NEEDED = 10
# A place that a third of the pairs point to is also aligned on its own.
PAIRS_STRONG = 3


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, at, before = [], [], []
    for k, value in enumerate(values):
        place = bisect_left(tails, value)
        before.append(at[place - 1] if place else -1)
        if place == len(tails):
            tails.append(value)
            at.append(k)
        else:
            tails[place], at[place] = value, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), ascending in both.

    Equal ends are matched first. Words that occur once in both are anchors; their longest
    increasing subsequence is kept and the gaps between them are aligned in the same way. A gap
    without anchors stays unmatched.
    """
    pairs, pending = [], [(0, len(text), 0, len(template))]
    while pending:
        a, b, c, d = pending.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {text[k]: k for k in range(a, b)}
        once = [k for k in range(c, d) if in_template[template[k]] == 1 and in_text[template[k]] == 1]
        chain = [(place[template[once[k]]], once[k]) for k in _increasing([place[template[k]] for k in once])]
        pairs += chain
        if chain:
            for (a1, c1), (b1, d1) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)]):
                pending.append((a1 + 1, b1, c1 + 1, d1))
    return sorted(pairs)


def _hashes(terms: Iterable[str]) -> set[int]:
    return set(words(pa.array([" ".join(terms)]))[0].tolist())


class Scanner:
    """Templates as word hashes, and the pairs of neighbouring words that point to them."""

    def __init__(self, templates: Sequence[Template], coverage: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates: they are broadcast")
        self.coverage, self.templates = coverage, templates
        stop, negations = _hashes(STOP_WORDS), _hashes(NEGATIONS)
        self.terms = [words(pa.array([x.text]))[0].tolist() for x in templates]
        self.required = [_hashes(x.required) for x in templates]
        self.forbidden = [_hashes(x.forbidden) for x in templates]
        self.negations = [negations if len(x) < NOTICE_WORDS and negations.isdisjoint(x) else set() for x in self.terms]
        self.slack = [max(3, len(x) // 4) for x in self.terms]
        self.counted: list[int] = []
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for number, terms in enumerate(self.terms):
            if len(terms) < 2:
                raise ValueError("a template needs two words")
            hashed = self.pair_hashes(np.array(terms, np.uint64)).tolist()
            telling = [k for k in range(len(hashed)) if not (terms[k] in stop and terms[k + 1] in stop)]
            for k in telling:
                self.pairs.setdefault(hashed[k], []).append((number, k))
            self.counted.append(len(telling))
        self.table = np.array(sorted(self.pairs), np.uint64)

    @staticmethod
    def pair_hashes(terms: np.ndarray) -> np.ndarray:
        return mix(mix(terms[:-1]) ^ terms[1:])

    def aligned(self, terms: np.ndarray, number: int, low: int, high: int) -> tuple[int, float, int, int, int] | None:
        """(words aligned, coverage, template, first word, end) if ``terms[low:high]`` holds the template."""
        template, low = self.terms[number], max(0, low)
        pairs = patience(terms[low:high].tolist(), template)
        share = len(pairs) / len(template)
        if share < self.coverage or not self.required[number] <= {template[c] for _, c in pairs}:
            return None
        start, end = low + pairs[0][0], low + pairs[-1][0] + 1
        if not self.forbidden[number].isdisjoint(terms[start:end].tolist()):
            return None
        if self.negations[number] and not self.negations[number].isdisjoint(terms[max(0, start - NEGATION_REACH) : end].tolist()):
            return None
        return len(pairs), share, number, start, end

    def find(self, terms: np.ndarray, seeds: np.ndarray, hashed: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, coverage) of all notices, none overlapping a better one.

        ``seeds``: places in ``terms`` where a template's pair of words stands.
        """
        starts: dict[int, Counter[int]] = {}
        for at, pair in zip(seeds.tolist(), hashed[seeds].tolist()):
            for number, offset in self.pairs[pair]:
                starts.setdefault(number, Counter())[at - offset] += 1
        hits = set()
        for number, votes in starts.items():
            size, slack, counted = len(self.terms[number]), self.slack[number], self.counted[number]
            places = sorted(votes)
            first = 0
            for k in range(1, len(places) + 1):
                if k < len(places) and places[k] - places[k - 1] <= slack:
                    continue
                region = places[first:k]
                first = k
                if sum(votes[p] for p in region) * PAIRS_NEEDED < counted:
                    continue
                hits.add(self.aligned(terms, number, region[0] - slack, region[-1] + size + slack))
                for p in region:
                    if votes[p] * PAIRS_STRONG >= counted:
                        hits.add(self.aligned(terms, number, p, p + size))
        out: list[tuple[int, int, int, float]] = []
        taken: list[int] = []  # bounds of what is taken, ascending: start, end, start, end ...
        for _, share, number, start, end in sorted(hits - {None}, key=lambda x: (-x[0], -x[1], x[4] - x[3], x[3], x[2])):
            at = bisect_right(taken, start)
            if at % 2 == 0 and at == bisect_left(taken, end):
                taken[at:at] = [start, end]
                out.append((number, start, end, share))
        return sorted(out, key=lambda x: x[1])


def scan(
    df: DataFrame, templates: Sequence[Template] = TEMPLATES, row_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, and ``found``, an array of (license, template, start, end, coverage).

    coverage is the share of the template's words that align; start and end count words of the
    text (A-Z lower-cased runs of letters, digits and characters beyond ASCII). Of overlapping
    finds the one with most aligned words stays, of equal ones that with the better coverage, then the shorter,
    then the first. A find holds the template's required words and none of its forbidden ones. Notices
    that a negation precedes or interrupts are no finds. Copies back to back are told apart where a
    third of a copy's pairs of neighbouring words stand as in the template. Null, empty and blank
    texts have no words and no finds; repeated rows and null ids give a row each. Other columns
    are ignored.
    """
    scanner = df.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))
    item = pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def task(batches):
        own = scanner.value
        for part in slices(batches, "text"):
            terms, bounds = words(part.column(1))
            hashed = Scanner.pair_hashes(terms) if len(terms) > 1 else np.zeros(0, np.uint64)
            seeds = np.flatnonzero(contained(hashed, own.table))
            seeds = seeds[~np.isin(seeds + 1, bounds)]  # pairs of one text only
            place = np.searchsorted(seeds, bounds)
            found = []
            for k in range(part.num_rows):
                a, b = bounds[k], bounds[k + 1]
                at = seeds[place[k] : place[k + 1]] - a
                hits = own.find(terms[a:b], at, hashed[a:b]) if len(at) else []
                found.append([
                    {"license": own.templates[n].license, "template": n, "start": s, "end": e, "coverage": c} for n, s, e, c in hits
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(found, pa.list_(item))], ["doc_id", "n_words", "found"]
            )

    rows = narrow(df, doc_id=row_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        task, f"doc_id {kind}, n_words long, found array<struct<license:string,template:int,start:long,end:long,coverage:double>>"
    )


def licenses(df: DataFrame, **options) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_notices, licenses (distinct, in order of name),
    license (of the find with the best coverage, of equal ones the first; null if none), coverage,
    n_license_words (words inside finds). Cases as in ``scan``.
    """
    best = F.array_sort(F.transform("found", lambda x, k: F.struct((-x["coverage"]).alias("c"), k.alias("k"), x["license"].alias("license"))))
    return scan(df, **options).select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_notices"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))).alias("licenses"),
        F.get(best, F.lit(0))["license"].alias("license"), F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_license_words"),
    )
