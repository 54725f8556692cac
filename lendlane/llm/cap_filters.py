"""Embedding near-duplicates by spherical-cap filters (locality-sensitive filtering with structured codes).

A vector is turned by a fixed random rotation and cut into blocks. Each block has a
small random code of unit vectors; a filter direction is one code word from each
block, so a few code words stand for very many directions. A vector belongs to
every filter whose direction it meets at more than a set cosine; these are listed
block by block, dropping whatever cannot reach the bound any more. Vectors of a
label that share a filter are compared, in double precision.

Equal vectors of a label are one class with a count. Each class is decoded and kept once,
with the list of its filters. Vectors meet in groups of neighbouring filters, which share
most of a direction: a vector goes once to each group that it has filters in, and is
compared there filter by filter. A pair of classes is counted in the first group where both
have a filter in common. A group of many is cut into blocks of vectors, and each pair of
blocks is a task of its own. Filters grow in number with the largest label, so that a
filter, and a group, hold about as many vectors at every size.

The search is not exhaustive. Vectors that no direction of a code meets well are
listed seldom, so there are several codes of independent rotations, and more of
them the more filters there are; the tests measure recall against brute force.

Vectors link only within a label and of the same length. A NULL label, vector or
vec_id, a zero vector, and a NULL or non-finite component link with nothing; such a row is its own component
(NULL for a NULL vec_id). Rows that share a vec_id are taken for one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import shuffle_partitions, sorted_groups, stored
from lendlane.llm.components import components

THRESHOLD = 0.93
# Filters of a code that a vector is in, on average; vectors a filter is meant to hold; the fewest filters.
FILTERS_EACH = 16
FILTER_VECTORS = 256
LEAST_FILTERS = 4096
# Filters a vector is in at least: its best ones, even below the bound.
LEAST_EACH = 4
# Vectors that a group of filters is meant to hold, and those of one block of a group.
BLOCK_VECTORS = 8192
# Vectors decoded at once, numbers held while they are, and pairs looked at at once.
DECODE_ROWS = 512
DECODE_NUMBERS = 1 << 20
COMPARE_PAIRS = 1 << 22
# Large groups up to which their list is broadcast (some 50 bytes each); a longer one is joined by a shuffle.
BROADCAST_GROUPS = 200_000
SEED = 7


class Code:
    """The filter directions for vectors of one length. Codes of other numbers are independent."""

    def __init__(self, length: int, filters: int, each: int = FILTERS_EACH, number: int = 0):
        random = np.random.default_rng([SEED, number, length])
        self.rotation = np.linalg.qr(random.standard_normal((length, length)))[0]
        n_blocks = min(length, 2 if filters <= 1 << 16 else 3)
        n_words = max(2, int(np.ceil(filters ** (1 / n_blocks))))
        self.cuts = [c for c in np.array_split(np.arange(length), n_blocks)]
        self.words = []
        for cut in self.cuts:
            words = random.standard_normal((n_words, len(cut)))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(n_blocks))
        self.n_words = n_words
        # The bound that random directions exceed as often as is wanted.
        trial = random.standard_normal((400, length))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        picked = [random.integers(0, n_words, 4096) for _ in self.cuts]
        scores = sum((trial[:, cut] @ words.T)[:, p] for cut, words, p in zip(self.cuts, self.words, picked))
        self.bound = float(np.quantile(scores, max(0.0, 1 - each / n_words**n_blocks)))

    def decode(self, vector: np.ndarray) -> np.ndarray:
        """Numbers of all filters beyond the bound, ascending, and at least the best few."""
        turned = vector @ self.rotation
        parts = [words @ turned[cut] for cut, words in zip(self.cuts, self.words)]
        best = np.cumsum([p.max() for p in parts[::-1]])[::-1]  # the most that this block and later ones can add
        for bound in (self.bound, -np.inf):
            numbers, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
            for k, part in enumerate(parts):
                later = best[k + 1] if k + 1 < len(parts) else 0.0
                total = sums[:, None] + part[None, :]
                i, j = np.nonzero(total + later >= bound - 1e-9)
                numbers, sums = numbers[i] * self.n_words + j, total[i, j]
                if bound == -np.inf and len(sums) > 64:
                    top = np.argsort(-sums, kind="stable")[:64]  # the best few need no more
                    numbers, sums = numbers[top], sums[top]
            if len(numbers) >= LEAST_EACH:
                break
        if len(numbers) < LEAST_EACH or bound == -np.inf:
            numbers = numbers[np.argsort(-sums, kind="stable")[:LEAST_EACH]]
        return np.sort(numbers)

    def decode_rows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many vectors: rows and their filters' numbers, in no order."""
        turned = units @ self.rotation
        parts = [turned[:, cut] @ words.T for cut, words in zip(self.cuts, self.words)]
        later = np.zeros((len(parts) + 1, len(units)))
        for k in range(len(parts) - 1, 0, -1):
            later[k] = later[k + 1] + parts[k].max(axis=1)
        row, number, total = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
        for k, part in enumerate(parts):
            kept = []
            step = max(1, DECODE_NUMBERS // self.n_words)
            for start in range(0, len(row), step):
                r, n, t = (x[start : start + step] for x in (row, number, total))
                sums = t[:, None] + part[r]
                i, j = np.nonzero(sums >= (self.bound - 1e-9 - later[k + 1][r])[:, None])
                kept.append((r[i], n[i] * self.n_words + j, sums[i, j]))
            row, number, total = (np.concatenate(c) for c in zip(*kept)) if kept else (row, number, total)
        few = np.bincount(row, minlength=len(units)) < LEAST_EACH
        best = [(r, self.decode(units[r])) for r in np.flatnonzero(few)]
        enough = ~few[row]
        return (np.concatenate([row[enough], *[np.full(len(n), r) for r, n in best]]),
                np.concatenate([number[enough], *[n for _, n in best]]))


class Codes:
    """Several codes side by side; their filters are numbered through."""

    def __init__(self, length: int, filters: int, each: int = FILTERS_EACH):
        # Two for the fewest filters, and one more as soon as there are more than that, 16 times as many, and so on.
        n = 2 + max(0, int(np.ceil(np.log2(filters / LEAST_FILTERS) / 4)))
        self.codes = [Code(length, filters, each, k) for k in range(n)]

    def decode(self, vector: np.ndarray) -> np.ndarray:
        """Numbers of the unit vector's filters in all codes, ascending."""
        first, numbers = 0, []
        for code in self.codes:
            numbers.append(first + code.decode(vector))
            first += code.n_words ** len(code.words)
        return np.concatenate(numbers)

    def decode_rows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many filters each unit vector has, and their numbers, ascending within a vector."""
        first, rows, numbers = 0, [], []
        for code in self.codes:
            row, number = code.decode_rows(units)
            rows.append(row)
            numbers.append(first + number)
            first += code.n_words ** len(code.words)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        return np.bincount(row, minlength=len(units)), number[np.lexsort((number, row))]


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, without a square that overflows or vanishes."""
    rows = raw.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows with their unit vector's key, and one row per class of equal vectors (`rep`, `copies`)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    any_set = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & good & any_set, F.lit(False))
    rows = rows.withColumn("usable", usable)
    found = rows.where("usable").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    return rows, found


def _rows(lists: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, one after the other, and the lengths of the lists."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten().to_numpy(zero_copy_only=False), whole.value_lengths().to_numpy(zero_copy_only=False)


def sizes(reps: DataFrame, each: int, block_vectors: int) -> tuple[int, int]:
    """How many filters a code has, and how many of them are a group, so that a group holds about a block of vectors."""
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    filters = max(LEAST_FILTERS, each * largest // FILTER_VECTORS)
    return filters, max(1, block_vectors * filters // max(1, each * largest))


def filtered(reps: DataFrame, filters: int, each: int = FILTERS_EACH) -> DataFrame:
    """Classes (`label`, `embedding`, `rep`, `copies`) with the numbers of their `filters`, ascending."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, Codes] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(begin, DECODE_ROWS)
                values, lengths = _rows(part.column("embedding"))
                starts = np.cumsum(lengths) - lengths
                found: list = [None] * part.num_rows
                for n in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == n)
                    codes = by_length.get(n) or by_length.setdefault(n, Codes(n, filters, each))
                    counts, numbers = codes.decode_rows(unit_vectors(values[starts[rows][:, None] + np.arange(n)]))
                    for row, own in zip(rows.tolist(), np.split(numbers, np.cumsum(counts)[:-1])):
                        found[row] = own
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "filters"])

    kind = dict(reps.dtypes)
    return reps.select("label", "embedding", "rep", "copies").mapInArrow(
        listed, f"label {kind['label']}, embedding {kind['embedding']}, rep long, copies long, filters array<long>")


def in_blocks(listed: DataFrame, group_filters: int, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Send each class to the groups it has filters in, deal those of large groups to blocks, and give every pair of blocks (`i`, `j`) its rows.

    `filters` are those of the group and, as far as they come before it, of others.
    """
    key = ["label", "size", "group"]
    groups = F.array_distinct(F.transform("filters", lambda f: F.floor(f / group_filters)))
    sent = listed.select("label", F.size("embedding").alias("size"), F.explode(groups).alias("group"), "rep", "copies", "embedding", "filters")
    large = stored(sent.groupBy(*key).count().where(F.col("count") > block_vectors).select(
        *[F.col(k).alias(f"l_{k}") for k in key], F.ceil(F.col("count") / block_vectors).cast("int").alias("blocks")), "large-groups")
    if large.count() <= BROADCAST_GROUPS:
        large = F.broadcast(large)
    same = [sent[k] == large[f"l_{k}"] for k in key]
    cut = sent.join(large, same, "left").drop(*[f"l_{k}" for k in key])
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    needed = F.filter("filters", lambda f: f < (F.col("group") + 1) * group_filters)
    return cut.select(*key, "rep", "copies", "embedding", needed.alias("filters"), own.alias("own"), F.explode(pairs).alias("pair")).select(
        *key, "pair.i", "pair.j", "own", "rep", "copies", "embedding", "filters")


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the smallest linked one, after links between `a` and `b` are added."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def verified(blocks: DataFrame, group_filters: int, threshold: float = THRESHOLD) -> DataFrame:
    """For each class and task with links: `rep`, `links` first found here, and `root`, the smallest class linked here."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, by_task):
            if table.num_rows < 2:
                continue
            column = lambda c: table.column(c).to_numpy()
            i, j, group = (table.column(c)[0].as_py() for c in ("i", "j", "group"))
            own, reps, copies = column("own"), column("rep"), column("copies")
            units = unit_vectors(_rows(table.column("embedding"))[0].reshape(table.num_rows, -1))
            filters, lengths = _rows(table.column("filters"))
            holder = np.repeat(np.arange(table.num_rows), lengths)
            here = filters >= group * group_filters
            known, place = np.unique(filters[here], return_inverse=True)
            member = np.zeros((len(known), table.num_rows), dtype=bool)
            member[place, holder[here]] = True
            earlier = [np.sort(f) for f in np.split(np.where(here, -1, filters), np.cumsum(lengths)[:-1])]
            left, right = (np.flatnonzero(own == b) for b in (i, j))
            on_right = [right[m[right]] for m in member]
            links, root = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
            smaller = np.argsort(reps, kind="stable")
            rank = np.empty(len(reps), dtype=np.int64)
            rank[smaller] = np.arange(len(reps))
            linked = np.zeros(len(reps), dtype=bool)
            step = max(1, COMPARE_PAIRS // len(reps))
            for start in range(0, len(left), step):
                rows = left[start : start + step]
                near = np.zeros((len(rows), len(reps)), dtype=bool)
                for m, others in zip(member, on_right):
                    some = np.flatnonzero(m[rows])
                    if len(some) and len(others):
                        near[np.ix_(some, others)] |= units[rows[some]] @ units[others].T >= threshold
                x, b = np.nonzero(near)
                a = rows[x]
                once = reps[a] < reps[b] if i == j else reps[a] != reps[b]
                a, b = a[once], b[once]
                if not len(a):
                    continue
                linked[a] = linked[b] = True
                root = _merged(root, rank[a], rank[b])
                first = _first_met(a, b, earlier)
                np.add.at(links, a[first], copies[b[first]])
                np.add.at(links, b[first], copies[a[first]])
            some = np.flatnonzero(linked)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[some]), pa.array(links[some]), pa.array(reps[smaller[root[rank[some]]]])], names=["rep", "links", "root"])

    by_task = ["label", "size", "group", "i", "j"]
    dealt = blocks.repartition(shuffle_partitions(blocks.sparkSession), *by_task).sortWithinPartitions(*by_task)
    return dealt.mapInArrow(compared, "rep long, links long, root long")


def _first_met(a: np.ndarray, b: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """Which pairs have no filter of an earlier group in common (-1 stands for a filter of this group)."""
    some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lists = [earlier[k][np.searchsorted(earlier[k], 0) :] for k in some.tolist()]
    known, place = np.unique(np.concatenate(lists), return_inverse=True)
    member = np.zeros((len(some), len(known) // 8 + 1), dtype=np.uint8)
    holder = np.repeat(np.arange(len(some)), [len(f) for f in lists])
    np.bitwise_or.at(member, (holder, place >> 3), np.left_shift(1, place & 7).astype(np.uint8))
    p, q = at[: len(a)], at[len(a) :]
    first = np.ones(len(a), dtype=bool)
    step = max(1, COMPARE_PAIRS // member.shape[1])
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        first[part] = ~(member[p[part]] & member[q[part]]).any(axis=1)
    return first


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, each: int = FILTERS_EACH,
                   block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for each row of `vectors` (`vec_id`, `embedding`, `label`)."""
    rows, found = classes(vectors)
    reps = stored(found, "vector-classes")
    filters, group_filters = sizes(reps, each, block_vectors)
    listed = stored(filtered(reps, filters, each), "caps")
    pairs = stored(verified(in_blocks(listed, group_filters, block_vectors), group_filters, threshold), "vector-links")
    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = components(pairs.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = reps.join(links, "rep", "left").join(rooted, reps["rep"] == rooted["node"], "left").select(
        F.col("label").alias("p_label"), F.col("embedding").alias("p_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    same = rows["usable"] & (rows["label"] == placed["p_label"]) & (rows["embedding"] == placed["p_embedding"])
    component = F.coalesce("component", "vec_id")
    return rows.join(placed, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
