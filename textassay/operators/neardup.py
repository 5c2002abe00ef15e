"""Near-duplicates: cosine of smooth TF-IDF vectors over all terms, reported as counts.

Equal texts, and texts with equal vectors, are collapsed first and enter the
counts as products of their sizes, so a group of copies that fills a third of the
corpus costs one row. All terms count in norm and cosine; document frequency only
orders them, rarest first. Vectors are compared block by block: products of rare terms
are added up, and where these and a bound on the common terms may reach the threshold the
cosine is worked out in full. Where links are asked for (``linked``), what hangs together already is not
compared again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textassay.functions.numbers import share
from textassay.operators.keyed import join_by_frequency
from textassay.operators.profile import digest
from textassay.operators.sampling import smallest
from textassay.operators.vocabulary import counted_tokens, smooth_idf
from textassay.session import broadcast_checked, discard, release, settle, ship, stored

# Bounds of the blocking vocabulary in the cost report; no bound of the similarity.
LOW_DF = 2
HIGH_PERCENT = 10
THRESHOLD = 0.8
SWEEP = (0.8, 0.85, 0.9, 0.95)
PRECISION_SAMPLE = 100
# Rounding of sums of rare terms, whose weights are held in single precision there.
SLACK = 1e-5
# Words are shuffled in so many slices, one after another.
SLICES = 2
# Vectors of a block and terms of them all, blocks whose rare terms a task indexes together, and blocks it compares with them.
BLOCK = 8_192
LEAST_BLOCK = 1_024
BLOCK_TERMS = 1 << 20
COLUMN_BLOCKS = 4
BLOCKS_PER_TASK = 16
# Rows of a strip (of so many cells) share a bound on the columns; so many meetings of terms are added up at a time.
STRIP_CELLS = 1 << 23
MEETINGS = 1 << 21
# Sums are held for the columns met alone if meetings are fewer than one in so many columns.
SPARSE = 8
# A vector's rare terms leave at most so much of its squared norm to the common ones; less where the threshold asks for it.
COMMON = 0.6
# Vectors that may belong together are compared so many at a time where links are asked for.
CROWD = 100

def distinct_texts(df: DataFrame, text: str = "text", row_id: str = "doc_id",
                   sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct text: smallest id, number of rows, extra sums, counted tokens.

    Copies are dropped by digest before anything is tokenised.
    """
    sums = sums or {}
    copies = (
        df.select(F.col(row_id).alias("id"), digest(text).alias("_d"), *[c.alias(n) for n, c in sums.items()])
        .groupBy("_d").agg(F.min("id").alias("id"), F.count("*").alias("n"), *[F.sum(n).alias(n) for n in sums])
        .drop("_d")
    )
    kept = df.select(F.col(row_id).alias("id"), F.col(text).alias("_text")).join(copies, "id")
    return kept.withColumn("_terms", counted_tokens(F.col("_text"))).drop("_text")


def term_frequencies(texts: DataFrame) -> DataFrame:
    """Distinct texts per term."""
    return texts.select(F.explode("_terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def is_frequent(percent: int) -> Column:
    """Whether a term is in more than ``percent`` of the distinct texts."""
    return F.col("df") * 100 > F.col("n_texts") * percent


def blocking_cost(frequencies: DataFrame, n_texts: DataFrame, low: int = LOW_DF, percent: int = HIGH_PERCENT) -> DataFrame:
    """Terms and term pairs inside and outside the band, before anything is joined.

    ``n_texts`` is one row with the number of distinct texts.
    """
    df = F.col("df")
    band = F.when(df < low, "below").when(is_frequent(percent), "above").otherwise("band")
    return frequencies.join(F.broadcast(n_texts)).groupBy(band.alias("part")).agg(
        F.count("*").alias("n_terms"), F.sum(df).alias("n_postings"), F.sum(F.expr("df * (df - 1) div 2")).alias("n_pairs")
    )


def numbered(frequencies: DataFrame) -> DataFrame:
    """Settled frequencies whose terms have a ``number`` each; a term of one text alone, which meets nothing, has a negative one."""
    place = F.monotonically_increasing_id()
    return settle(frequencies.withColumn("number", F.when(F.col("df") > 1, place).otherwise(-1 - place)))


def vectors(rows: DataFrame, frequencies: DataFrame, n_texts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Vectors over all terms: ``id`` and ``vec``, texts, number and weight of each term, rarest first; not scaled to a norm.

    ``rows`` has ``id`` and ``_terms``, ``frequencies`` is ``numbered``. Rows without a term have no vector. The rows of
    ``base`` come with their vectors, if it is given.
    Weights depend on the two counts alone, so few are different and files stay small. All words are shuffled by
    term and then by id, a ``SLICES``-th of them at a time, and a slice's shuffle goes before the next one comes.
    """
    def sliced(df, key):
        return [df.filter(F.pmod(F.xxhash64(key), F.lit(SLICES)) == k) for k in range(SLICES)]

    postings = rows.select("id", F.inline("_terms"))
    weight = (F.col("tf") * smooth_idf(F.col("n_texts"), F.col("df"))).alias("w")
    parts = [
        settle(join_by_frequency(own, known, "term", "df", "id").join(F.broadcast(n_texts)).select("id", "df", F.col("number").alias("term"), weight))
        for own, known in zip(sliced(postings, "term"), sliced(frequencies, "term"))
    ]
    weighted = reduce(DataFrame.unionByName, parts)
    ordered = F.sort_array(F.collect_list(F.struct("df", "term", "w")))
    found = [own.repartition("id").groupBy("id").agg(ordered.alias("vec")) for own in sliced(weighted, "id")]
    if base is not None:
        found = [kept.join(vec, "id", "left") for kept, vec in zip(sliced(base, "id"), found)]
    settled = reduce(DataFrame.unionByName, map(settle, found))
    discard(*parts)
    return settled


def groups(df: DataFrame, text: str = "text", row_id: str = "doc_id", sums: dict[str, Column] | None = None) -> DataFrame:
    """One settled row per distinct vector: ``id``, ``n`` rows, extra sums, ``vec``.

    Texts with the same counted tokens have the same vector, so they are merged before any weight is
    worked out. A text without tokens stays a group of its own copies. Frequencies are over distinct texts.
    """
    sums = sums or {}
    texts = settle(distinct_texts(df, text, row_id, sums))
    frequencies = numbered(term_frequencies(texts))
    parts = F.transform("_terms", lambda e: F.concat_ws(":", e["term"], e["tf"].cast("string")))
    bag = F.when(F.size("_terms") > 0, F.sha2(F.array_join(parts, ",").cast("binary"), 256)).otherwise(F.concat(F.lit("id:"), F.col("id")))
    merged = settle(
        texts.withColumn("_bag", bag)
        .groupBy("_bag").agg(F.min("id").alias("id"), F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).drop("_bag")
    )
    n_texts = texts.agg(F.count("*").alias("n_texts"))
    # Texts whose vector another one stands for: few as a rule, so that words of the others need no shuffle here.
    merged_away = settle(texts.select("id").join(merged.select("id"), "id", "left_anti"))
    found = vectors(texts.select("id", "_terms").join(broadcast_checked(merged_away), "id", "left_anti"), frequencies, n_texts, merged)
    discard(texts, frequencies, merged, merged_away)
    return found


def dot(left: Column, right: Column) -> Column:
    """Dot product of two term-to-weight maps; hashes the keys, linear in their number."""
    products = F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(F.map_values(products), F.lit(0.0), lambda acc, x: acc + x)


def _elements(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each list of structs ends, a zero first, and the fields of all elements."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], [column.to_numpy() for column in lists.flatten().flatten()]


def _cut(threshold: float) -> float:
    """Share of the squared norm that common terms may keep: their norm alone must stay below the threshold."""
    return min(COMMON, 0.95 * threshold * threshold)


def _blocks(vec: DataFrame, threshold: float) -> tuple[str, list[int]]:
    """Folder of the vectors in blocks of about ``BLOCK``, by how common the last of their rare terms is, and the blocks in order.

    Long vectors make smaller blocks, of ``BLOCK_TERMS`` terms.

    Rare terms (``head``) end where the common ones keep no more than ``_cut`` of the squared norm; ``single`` is what
    terms of one text alone have of it. Weights are parts of the norm.
    """
    cut, id_type = _cut(threshold), vec.schema["id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            ends, (df, term, w) = _elements(batch.column(1))
            if not len(batch):
                continue
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(batch)), sizes)
            if ((term[1:] == term[:-1]) & (row[1:] == row[:-1])).any():
                raise ValueError("an id stands for more than one row; near-duplicates need unique ids")
            w = w / np.sqrt(np.bincount(row, w * w, len(batch)))[row]
            total = np.append(0.0, np.cumsum(w * w))
            rest = total[ends[1:]][row] - total[1:]
            size = np.minimum(np.bincount(row[rest > cut], minlength=len(batch)) + 1, sizes)
            head = np.arange(len(row)) - np.repeat(ends[:-1], sizes) < size[row]
            met = head & (term >= 0)

            def lists(kept, values):
                offsets = np.append(0, np.cumsum(np.bincount(row[kept], minlength=len(batch)))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept]))

            last = ends[:-1] + size - 1
            behind = np.sqrt(np.bincount(row[~head], w[~head] ** 2, len(batch)))
            single = np.bincount(row[term < 0], w[term < 0] ** 2, len(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(df[last]), pa.array(term[last]), pa.array(behind), pa.array(single),
                lists(met, df), lists(met, term), lists(met, w), lists(~head & (term >= 0), term), lists(~head & (term >= 0), w),
            ], names)

    names = ["id", "need", "upto", "behind", "single", "df", "head", "head_w", "tail", "tail_w"]
    rows = vec.mapInArrow(task, (
        f"id {id_type}, need bigint, upto bigint, behind double, single double, df array<bigint>, head array<bigint>, head_w array<double>, "
        "tail array<bigint>, tail_w array<double>"
    ))
    n = vec.count()
    # Smaller blocks if cores had nothing to do otherwise.
    count = max(1, -(-n // BLOCK), min(2 * vec.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    order = ["need", "upto", F.xxhash64("id"), "id"]
    ordered = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)

    most = BLOCK_TERMS

    def cut_up(batches):
        total, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = sum(batch.column(batch.schema.get_field_index(name)).offsets.to_numpy().astype(np.int64) for name in ("head", "tail"))
            block = (total + ends[:-1] - ends[0]) // most
            total += int(ends[-1] - ends[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + block)], [*batch.schema.names, "block"])

    folder = stored(ordered.mapInArrow(cut_up, StructType([*ordered.schema.fields, StructField("block", LongType())])), "block")
    found = vec.sparkSession.read.schema("block bigint").parquet(folder).distinct().collect() if n else []
    return folder, sorted(row.block for row in found)


def _read(folder: str, number: int, columns: list[str]) -> pa.Table:
    """Columns of one block, its vectors in order."""
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:/") else "file://" + folder[len("file:"):])
    table = parquet.read_table(f"{path}/block={number}", filesystem=system, partitioning=None, columns=[*columns, "need", "upto"]).combine_chunks()
    need, upto = table["need"].to_numpy(), table["upto"].to_numpy()
    same = need[1:] == need[:-1]
    if ((need[1:] < need[:-1]) | same & (upto[1:] < upto[:-1])).any():  # the writer may have sorted by block once more
        table = table.take(pa.array(np.lexsort((upto, need)))).combine_chunks()
    return table


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column ends, a zero first, and all elements."""
    lists = table[name].combine_chunks()
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten().to_numpy()


class _Rows:
    """Whole unit vectors of one block."""

    def __init__(self, table: pa.Table):
        self.n, self.ids = len(table), table["id"].combine_chunks()
        parts = [_lists(table, name) for name in ("head", "tail")]
        row = np.concatenate([np.repeat(np.arange(self.n), np.diff(ends)) for ends, _ in parts])
        by = np.argsort(row, kind="stable")
        self.term = np.concatenate([terms for _, terms in parts])[by]
        self.w = np.concatenate([_lists(table, name)[1] for name in ("head_w", "tail_w")])[by]
        self.ends = np.append(0, np.cumsum(np.bincount(row, minlength=self.n)))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, weights and numbers of terms of some rows."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        at = _ranges(self.ends[rows], sizes)
        return self.term[at], self.w[at], sizes


class _Index:
    """Rare terms of some neighbouring blocks: the vectors that have each, as columns."""

    def __init__(self, folder: str, blocks: list[int]):
        self.first, term, df, w, column, single = {}, [], [], [], [], []
        self.n = 0
        for number in blocks:
            self.first[number] = self.n
            table = _read(folder, number, ["single", "df", "head", "head_w"])
            ends, terms = _lists(table, "head")
            term.append(terms)
            df.append(_lists(table, "df")[1])
            w.append(_lists(table, "head_w")[1])
            column.append(np.repeat(np.arange(self.n, self.n + len(table), dtype=np.int32), np.diff(ends)))
            single.append(table["single"].to_numpy())
            self.n += len(table)
        # What terms of fewer than ``below`` texts have of a vector's squared norm.
        self.single, self.below = np.concatenate(single), 0
        self.mass, term = self.single.copy(), np.concatenate(term)
        by = np.argsort(term, kind="stable")
        term = term[by]
        self.starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.term, self.starts = term[self.starts], np.append(self.starts, len(term))
        del term
        self.df = np.concatenate(df)[by[self.starts[:-1]]] if len(self.term) else np.zeros(0, np.int64)
        self.column, self.w = np.concatenate(column)[by], np.concatenate(w)[by].astype(np.float32)

    def behind(self, df: int) -> np.ndarray:
        """Norm of each vector in terms of ``df`` texts and more."""
        if df < self.below:
            self.below, self.mass = 0, self.single.copy()
        more = np.flatnonzero((self.df >= self.below) & (self.df < df))
        at = _ranges(self.starts[more], self.starts[more + 1] - self.starts[more])
        self.mass += np.bincount(self.column[at], self.w[at].astype(float) ** 2, self.n)
        self.below = df
        return np.sqrt(np.maximum(0.0, 1 - self.mass))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one behind the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _candidates(table: pa.Table, index: _Index, own: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block and columns of the index whose cosine may reach the threshold.

    A row's rare terms end no later than those of the columns behind it, so products of all rare terms of the
    row are added up. What common terms add is at most the product of both norms there. ``own`` is the column
    of the block's first row, if the index holds the block; a row is compared with columns after it.
    """
    ends, terms = _lists(table, "head")
    weights, behind = _lists(table, "head_w")[1], table["behind"].to_numpy()
    place = np.searchsorted(index.term, terms)
    known = np.append(index.term, -1)[place] == terms
    place = np.where(known, place, 0)
    start = index.starts[place] if len(index.term) else np.zeros(len(terms), np.int64)
    stop = np.where(known, index.starts[np.minimum(place + 1, len(index.starts) - 1)], start)
    need = table["need"].to_numpy()
    rows, columns = [], []
    height = max(1, STRIP_CELLS // index.n)
    for top in range(0, len(table), height):
        # The strip's rows come in the order of their needs, so the first has the least.
        theirs = index.behind(int(need[top]))
        for r in range(top, min(len(table), top + height)):
            met = slice(ends[r], ends[r + 1])
            counts = stop[met] - start[met]
            held = np.flatnonzero(counts)
            if not len(held):
                continue
            a, b, w, counts = start[met][held], stop[met][held], weights[met][held], counts[held]
            part = np.cumsum(counts) // MEETINGS
            sums = 0.0
            for k in range(part[0], part[-1] + 1):
                some = slice(*np.searchsorted(part, (k, k + 1)))
                spans = [slice(x, y) for x, y in zip(a[some].tolist(), b[some].tolist())]
                if spans:
                    products = np.concatenate([index.w[x] for x in spans])
                    products *= np.repeat(w[some].astype(np.float32), counts[some])
                    column = np.concatenate([index.column[x] for x in spans])
                    if part[0] == part[-1] and len(column) * SPARSE < index.n:
                        break  # too few for a sum in every column
                    sums = sums + np.bincount(column, products, index.n)
            else:
                sums += behind[r] * theirs
                if own is not None:
                    sums[: own + r + 1] = 0.0
                column = np.flatnonzero(sums >= threshold - SLACK)
                rows.append(np.full(len(column), r))
                columns.append(column)
                continue
            by = np.argsort(column)
            column = column[by]
            edges = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            sums, column = np.add.reduceat(products[by], edges), column[edges]
            found = column[(sums + behind[r] * theirs[column] >= threshold - SLACK) & (column > (-1 if own is None else own + r))]
            rows.append(np.full(len(found), r))
            columns.append(found)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _close(ours: _Rows, theirs: _Rows, x: np.ndarray, y: np.ndarray, threshold: float, joined: _Joined | None):
    """Of the pairs of rows ``x, y`` those with a cosine at or above the threshold, in pieces: ``row, row, cosine``.

    With ``joined`` only pairs that join what it does not know to hang together.
    """
    rows, edges = np.unique(x, return_index=True)
    asked = np.unique(y)
    own, own_w, own_sizes = ours.of(rows)
    own_ends = np.append(0, np.cumsum(own_sizes))
    names, own = np.unique(own, return_inverse=True)
    terms, weights, sizes = theirs.of(asked)
    place = np.searchsorted(names, terms)
    shared = np.append(names, -1)[place] == terms
    place, weights = place[shared], weights[shared]
    ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(asked)), sizes)[shared], minlength=len(asked))))
    dense = np.zeros(len(names))
    for number, (r, start, stop) in enumerate(zip(rows, edges, np.append(edges[1:], len(x)))):
        used = own[own_ends[number] : own_ends[number + 1]]
        dense[used] = own_w[own_ends[number] : own_ends[number + 1]]
        left = y[start:stop]
        while len(left):
            if joined is not None:
                left = left[joined.apart(r, left)]
            step, left = (left, left[:0]) if joined is None else (left[: joined.crowd], left[joined.crowd :])
            if not len(step):
                break
            k = np.searchsorted(asked, step)
            held = ends[k + 1] > ends[k]
            cosine = np.zeros(len(k))
            if held.any():
                k = k[held]
                spans = [slice(a, b) for a, b in zip(ends[k].tolist(), ends[k + 1].tolist())]
                products = dense[np.concatenate([place[span] for span in spans])] * np.concatenate([weights[span] for span in spans])
                cosine[held] = np.add.reduceat(products, np.append(0, np.cumsum(ends[k + 1] - ends[k])[:-1]))
            close = cosine >= threshold
            if joined is not None:
                close[close] = joined.join(r, step[close])
            if close.any():
                yield np.full(close.sum(), r), step[close], cosine[close]
        dense[used] = 0.0


class _Joined:
    """Which rows of a block and columns of an index hang together, as far as a task knows."""

    def __init__(self, columns: int, crowd: int):
        self.label, self.n, self.crowd = np.arange(columns), columns, crowd

    def begin(self, rows: int, own: int | None) -> None:
        """Another block of rows comes, which may be columns too."""
        self.label = self.label[: self.n]
        self.row = self.n if own is None else own
        if own is None:
            # Those of columns are columns, so that they stay when the rows go.
            self.label = np.append(self.label, np.arange(self.n, self.n + rows))

    def at(self, base: int) -> _Joined:
        """Columns are counted from this one on."""
        self.base = base
        return self

    def apart(self, r: int, y: np.ndarray) -> np.ndarray:
        """Which columns do not hang together with a row yet."""
        return self.label[self.base + y] != self.label[self.row + r]

    def join(self, r: int, y: np.ndarray) -> np.ndarray:
        """Join a row with others; which of them were apart until then."""
        new = np.zeros(len(y), bool)
        for k, other in enumerate(y):
            mine, its = self.label[self.row + r], self.label[self.base + other]
            if mine != its:
                self.label[self.label == max(mine, its)] = min(mine, its)
                new[k] = True
        return new


def _pairs(vec: DataFrame, threshold: float, crowd: int | None = None) -> DataFrame:
    """Settled pairs ``a < b, cosine`` of ``id, vec`` at or above the threshold; with ``crowd`` only such that connect what all connect.

    A task holds the rare terms of a few neighbouring blocks and compares other blocks with them. It reads all of them from
    the shared folder: nothing is shuffled but vectors once and pairs found, and a task's memory does not grow.
    """
    spark = vec.sparkSession
    ship(spark)
    folder, blocks = _blocks(vec, threshold)
    n = len(blocks)
    kind = vec.schema["id"].dataType.simpleString()
    whole, wide = ["id", "head", "head_w", "tail", "tail_w"], COLUMN_BLOCKS

    def task(batches):
        held = (-1, None, None)
        for batch in batches:
            for group, i in zip(*(column.to_pylist() for column in batch.columns)):
                if held[0] != group:
                    held = (-1, None, None)
                    index = _Index(folder, blocks[group * wide : (group + 1) * wide])
                    held = (group, index, _Joined(index.n, crowd) if crowd else None)
                _, index, joined = held
                table = _read(folder, blocks[i], [*whole, "behind"])
                own = index.first.get(blocks[i])
                x, y = _candidates(table, index, own, threshold)
                release()
                if not len(x):
                    continue
                ours = _Rows(table)
                del table
                if joined:
                    joined.begin(ours.n, own)
                for (number, base), end in zip(index.first.items(), [*list(index.first.values())[1:], index.n]):
                    some = (y >= base) & (y < end)
                    if not some.any():
                        continue
                    theirs = ours if number == blocks[i] else _Rows(_read(folder, number, whole))
                    for u, v, cosine in _close(ours, theirs, x[some], y[some] - base, threshold, joined and joined.at(base)):
                        yield pa.RecordBatch.from_arrays([ours.ids.take(pa.array(u)), theirs.ids.take(pa.array(v)), pa.array(cosine)], ["x", "y", "cosine"])
        release()

    groups = -(-n // wide)
    # Blocks of the commonest terms, which take longest, come first.
    at = F.lit(n * groups - 1) - F.col("id")
    i, group = (at % max(1, n)).cast("int").alias("i"), F.floor(at / max(1, n)).cast("int").alias("g")
    tasks = max(1, min(n * groups, max(4 * spark.sparkContext.defaultParallelism, n * groups // BLOCKS_PER_TASK)))
    # Neighbours in this list share a group, whose index a task builds once.
    asked = spark.range(0, n * groups, 1, tasks).select(group, i).filter(F.col("i") < (F.col("g") + 1) * wide)
    found = asked.mapInArrow(task, f"x {kind}, y {kind}, cosine double")
    pairs = settle(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine").filter("a < b"))
    if n:
        discard(spark.read.parquet(folder))
    return pairs


def similar_pairs(grouped: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair of groups with cosine at or above the threshold: ``a < b, cosine``."""
    return _pairs(grouped.filter("vec is not null").select("id", "vec"), threshold)


def linked(grouped: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Links ``a < b`` that connect exactly what the pairs at or above the threshold connect; each is such a pair.

    A task keeps only links that join what it does not know to hang together, and compares a vector with ``crowd`` others
    at a time: what those join needs no more comparing. So a task's links are fewer than its vectors, however large a family is.
    """
    return _pairs(grouped.filter("vec is not null").select("id", "vec"), threshold, crowd).select("a", "b")


def cosines(pairs: DataFrame, vec: DataFrame) -> DataFrame:
    """Cosine of each (a, b); null when one of them has no vector."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    square = F.aggregate("vec", F.lit(0.0), lambda total, e: total + e["w"] * e["w"])
    maps = settle(
        vec.filter("vec is not null").join(asked, "id", "left_semi").select("id", F.map_from_arrays("vec.term", "vec.w").alias("m"), F.sqrt(square).alias("norm"))
    )
    for side in "ab":
        pairs = pairs.join(maps.select(F.col("id").alias(side), *(F.col(x).alias(x + side) for x in ("m", "norm"))), side, "left")
    return pairs.withColumn("cosine", dot(F.col("ma"), F.col("mb")) / F.col("norma") / F.col("normb")).drop("ma", "mb", "norma", "normb")


def with_sizes(pairs: DataFrame, grouped: DataFrame, names: list[str]) -> DataFrame:
    """Attach the group columns of both ends, suffixed ``_a`` and ``_b``."""
    for side in ("a", "b"):
        ends = grouped.select(F.col("id").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names])
        pairs = pairs.join(ends, side)
    return pairs


def sweep(grouped: DataFrame, pairs: DataFrame, thresholds=SWEEP) -> DataFrame:
    """Row pairs and rows involved per threshold, from the pairs of the lowest one."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    sized = with_sizes(pairs, grouped, ["n"]).withColumn("threshold", at).filter(F.col("cosine") >= F.col("threshold"))
    across = sized.groupBy("threshold").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("across"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "cosine").groupBy("id").agg(F.max("cosine").alias("best"))
    n = F.col("n")
    involved = (
        grouped.select("id", "n").join(ends, "id", "left").withColumn("threshold", at).groupBy("threshold").agg(
            F.sum(F.expr("n * (n - 1) div 2")).alias("inside"),
            F.sum(F.when((n > 1) | (F.col("best") >= F.col("threshold")), n).otherwise(0)).alias("rows_involved"),
        )
    )
    return involved.join(across, "threshold", "left").select(
        "threshold", (F.col("inside") + F.coalesce("across", F.lit(0))).alias("n_pairs"), "rows_involved"
    )


def cross_split(grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """Row pairs with one row in train and one in test; groups carry ``n_train`` and ``n_test``."""
    across = with_sizes(pairs, grouped, ["n_train", "n_test"]).agg(
        F.count("*").alias("k"),
        F.coalesce(F.sum(F.col("n_train_a") * F.col("n_test_b") + F.col("n_test_a") * F.col("n_train_b")), F.lit(0)).alias("x"),
    )
    inside = grouped.agg(F.coalesce(F.sum(F.col("n_train") * F.col("n_test")), F.lit(0)).alias("y"))
    # Two frames of exactly one row each.
    return across.join(F.broadcast(inside)).select((F.col("x") + F.col("y")).alias("n_cross_pairs"))


def precision_sample(pairs: DataFrame, n: int = PRECISION_SAMPLE, seed: int = 0) -> DataFrame:
    """Pairs to read by eye, drawn like any other sample."""
    return smallest(pairs.withColumn("pair", F.concat_ws("-", "a", "b")), n, seed, "pair")


def title_pairs(df: DataFrame, max_count: int = 3, title: str = "title", row_id: str = "doc_id") -> DataFrame:
    """Row pairs that share a title seen two or three times.

    Smallest, largest and xor of the ids identify up to three rows, so no list is
    built for a title, however frequent.
    """
    if max_count > 3:
        raise ValueError("the tail has at most three rows per title")
    ids = df.groupBy(title).agg(
        F.count("*").alias("n"), F.min(row_id).alias("lo"), F.max(row_id).alias("hi"), F.bit_xor(row_id).alias("x")
    ).filter(F.col("n").between(2, max_count))
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))

    def pair(a, b):
        return F.struct(a.alias("a"), b.alias("b"))

    lo, hi = F.col("lo"), F.col("hi")
    return ids.select(F.inline(F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(
        F.array(pair(lo, mid), pair(lo, hi), pair(mid, hi))
    )))


def title_recall(df: DataFrame, threshold: float = THRESHOLD, title: str = "title", scored: str = "description",
                 row_id: str = "doc_id") -> DataFrame:
    """Share of same-title pairs found by the similarity of the other field alone."""
    texts = settle(distinct_texts(df, scored, row_id))
    frequencies = numbered(term_frequencies(texts))
    truth = settle(title_pairs(df, 3, title, row_id))
    ids = truth.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = df.select(F.col(row_id).alias("id"), F.col(scored).alias("_s")).join(ids, "id")
    vec = vectors(rows.select("id", counted_tokens(F.col("_s")).alias("_terms")), frequencies,
                  texts.agg(F.count("*").alias("n_texts")))
    keys = rows.select("id", digest("_s").alias("d"))
    scoredp = cosines(truth, vec)
    for side in ("a", "b"):
        scoredp = scoredp.join(keys.select(F.col("id").alias(side), F.col("d").alias("d" + side)), side)
    match = (F.col("cosine") >= threshold) | (F.col("da") == F.col("db"))
    return scoredp.agg(F.count("*").alias("n_truth"), F.count_if(match).alias("n_found")).withColumn(
        "recall", share(F.col("n_found"), F.col("n_truth"))
    )


def clusters(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs: ``id`` and ``cluster``, the smallest id in it.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of the longest
    chain. A cluster may be large; lookups by label are cut into pieces.
    """
    edges = settle(pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))
    ))))
    labels = settle(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("cluster")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(
            F.min("cluster").alias("near")
        )
        better = settle(labels.join(near, "id").select("id", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster")))
        sizes = better.groupBy("cluster").agg(F.count("*").alias("_n"))
        lookup = better.select(F.col("id").alias("cluster"), F.col("cluster").alias("root")).join(sizes, "cluster")
        jumped = settle(join_by_frequency(better, lookup, "cluster", "_n", "id").select(
            "id", "old", F.col("root").alias("cluster")
        ))
        labels = jumped.select("id", "cluster")
        if jumped.filter(F.col("old") != F.col("cluster")).isEmpty():
            return labels


def duplicate_units(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters, rows involved and rows beyond the first of each cluster."""
    sizes = (
        grouped.select("id", "n").join(labels, "id", "left")
        .groupBy(F.coalesce("cluster", "id").alias("cluster")).agg(F.sum("n").alias("rows"))
        .filter("rows > 1")
    )
    zero = F.lit(0)
    return sizes.agg(
        F.count("*").alias("n_clusters"),
        F.coalesce(F.sum("rows"), zero).alias("rows_involved"),
        F.coalesce(F.sum(F.col("rows") - 1), zero).alias("rows_beyond_first"),
    )


def cluster_classes(grouped: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """One row per cluster of two or more vectors: its texts, its rows and the links that hold it together."""
    sizes = grouped.select("id", "n").join(labels, "id").groupBy("cluster").agg(F.count("*").alias("n_vectors"), F.sum("n").alias("n_rows"))
    held = links.join(labels, F.col("a") == F.col("id")).groupBy("cluster").agg(F.count("*").alias("n_links"))
    return sizes.join(held, "cluster").select("cluster", "n_vectors", "n_rows", "n_links")
