"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds over cover trees.

Vectors are cut into equal consecutive parts, and each part is replaced by the number of the nearest entry of its
position's codebook. Components become integers first, so every distance, sum and mean is exact and
no result depends on how the vectors are dealt out.

Each task gathers its vectors into bounded blocks and grows a cover tree for each part position: a node
covers its points within a radius, its children are a net at half that radius, more than that
apart. Points lie in tree order, so that a subtree is a range and two cumulative sums
give the sum of its points. The trees are stored once. In a round, a node whose centre is nearer
to one entry than to any other by more than its diameter gives its whole subtree to that entry, by the
triangle inequality; others are opened, and in ambiguous leaves points are compared exactly. Only
counts and sums per entry leave a task; they are added up by Spark, and the codebooks, as long as
`entries` vectors, go back to the tasks.

Rows whose vector is NULL, or holds NULL or non-finite components, are dropped. A NULL `vec_id` is kept and comes after
all others in the order that gives the first codebook; equal ids are ordered by vector. With fewer vectors than entries there are fewer
entries. Vectors shorter than the longest, and those whose length is no multiple of the parts, count as if zeros followed.
Components beyond 2^26 steps count as 2^26, so that squared distances fit a long. No vectors, no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import stored

# Steps of a component, part positions, entries of a codebook, rounds.
STEPS = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 26
# Points of a leaf, and the bytes and vectors of a block.
LEAF = 12
BLOCK_BYTES = 1 << 22
BLOCK_VECTORS = 1 << 14


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of `a` and rows of `b`."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


@dataclass
class Tree:
    """A cover tree over distinct points. `points` are in tree order; `at` places the block's vectors among them."""

    points: np.ndarray
    at: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray

    FIELDS = ("points", "at", "centre", "radius", "begin", "end", "child", "children")

    def __post_init__(self) -> None:
        copies = np.bincount(self.at, minlength=len(self.points))
        zero = np.zeros((1, self.points.shape[1]), dtype=np.int64)
        #: Vectors, and the sum of vectors, before each point in tree order.
        self.count = np.concatenate([[0], np.cumsum(copies)])
        self.sums = np.concatenate([zero, np.cumsum(self.points * copies[:, None], axis=0)])

    @classmethod
    def grow(cls, vectors: np.ndarray, leaf: int = LEAF) -> "Tree":
        """A tree over the rows of an integer matrix, which has one row at least."""
        points, at = np.unique(vectors, axis=0, return_inverse=True)
        order = np.arange(len(points))
        nodes = [[int(0), 0.0, 0, len(points), 0, 0]]  # centre, radius, begin, end, first child, children
        k = 0
        while k < len(nodes):
            centre, _, begin, end, _, _ = nodes[k]
            here = points[order[begin:end]]
            near = np.sqrt(squared(here, points[centre : centre + 1])[:, 0].astype(np.float64))
            nodes[k][1] = float(near.max())
            if end - begin > leaf:
                half, owner, centres = nodes[k][1] / 2, np.zeros(end - begin, dtype=np.int64), [centre]
                while True:
                    far = int(near.argmax())
                    if near[far] <= half:
                        break
                    distance = np.sqrt(squared(here, here[far : far + 1])[:, 0].astype(np.float64))
                    closer = distance < near
                    owner[closer] = len(centres)
                    near[closer] = distance[closer]
                    centres.append(int(order[begin + far]))
                by_owner = np.argsort(owner, kind="stable")
                order[begin:end] = order[begin:end][by_owner]
                stops = np.cumsum(np.bincount(owner, minlength=len(centres))) + begin
                nodes[k][4:] = [len(nodes), len(centres)]
                nodes += [[c, 0.0, int(a), int(b), 0, 0] for c, a, b in zip(centres, [begin, *stops], stops)]
            k += 1
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        table = np.array([n[:1] + n[2:] for n in nodes], dtype=np.int64)
        return cls(points[order], place[at.reshape(-1)], place[table[:, 0]], np.array([n[1] for n in nodes]), *table[:, 1:].T)

    def packed(self) -> bytes:
        out = io.BytesIO()
        small = lambda a: a if a.dtype.kind == "f" else a.astype(np.int32)
        np.savez(out, **{f: small(getattr(self, f)) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> "Tree":
        with np.load(io.BytesIO(raw)) as held:
            return cls(**{f: held[f] if held[f].dtype.kind == "f" else held[f].astype(np.int64) for f in cls.FIELDS})

    def ranges(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All points as ranges (begin, end) in tree order with the nearest entry of each, the earlier one where two are."""
        # An entry that repeats an earlier one is never chosen.
        different = np.sort(np.unique(codebook, axis=0, return_index=True)[1])
        entries = codebook[different]
        begins, ends, chosen = [], [], []

        def give(begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> None:
            begins.append(begin)
            ends.append(end)
            chosen.append(different[entry])

        open_ = np.zeros(1, dtype=np.int64)
        while len(open_):
            distance = squared(self.points[self.centre[open_]], entries)
            best = distance.argmin(axis=1)
            if len(entries) > 1:
                two = np.sqrt(np.partition(distance, 1, axis=1)[:, :2].astype(np.float64))
                # Every point is within the radius of the centre. A little more, for the roots' rounding.
                clear = two[:, 1] - two[:, 0] > 2 * self.radius[open_] + 1e-9 * two[:, 1] + 1e-6
            else:
                clear = np.ones(len(open_), dtype=bool)
            give(self.begin[open_[clear]], self.end[open_[clear]], best[clear])
            unclear = open_[~clear]
            leaf = self.children[unclear] == 0
            points = _spans(self.begin[unclear[leaf]], self.end[unclear[leaf]])
            if len(points):
                give(points, points + 1, squared(self.points[points], entries).argmin(axis=1))
            inner = unclear[~leaf]
            open_ = _spans(self.child[inner], self.child[inner] + self.children[inner])
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(chosen)

    def statistics(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of each entry and their sum, from the cumulative sums at the ends of ranges."""
        begin, end, entry = self.ranges(codebook)
        n, sums = np.zeros(len(codebook), dtype=np.int64), np.zeros(codebook.shape, dtype=np.int64)
        np.add.at(n, entry, self.count[end] - self.count[begin])
        np.add.at(sums, entry, self.sums[end] - self.sums[begin])
        return n, sums

    def codes(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each vector of the block, and its squared distance."""
        begin, end, entry = self.ranges(codebook)
        of_point = np.empty(len(self.points), dtype=np.int64)
        of_point[_spans(begin, end)] = np.repeat(entry, end - begin)
        error = ((self.points - codebook[of_point]) ** 2).sum(axis=1)
        return of_point[self.at], error[self.at]


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... up to end, for each pair in turn."""
    n = end - begin
    return np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())


def whole_numbers(vectors: pa.Array, length: int) -> np.ndarray:
    """A matrix of integer components from a list column without NULLs; shorter vectors are filled up with zeros."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    each = np.diff(np.asarray(vectors.offsets))
    if (each != length).any():
        out = np.zeros((len(vectors), length))
        out[np.arange(length) < each[:, None]] = flat
    else:
        out = flat.reshape(-1, length)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(STEPS * out), -LARGEST, LARGEST).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `embedding`, `label` of the rows that are kept."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return rows.where(F.coalesce(F.col("embedding").isNotNull() & good, F.lit(False)))


def grow_trees(rows: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """Blocks of vectors: `vec_id` and `label` as lists, and a tree for each part position."""
    kind = dict(rows.dtypes)["label"]
    width = length // parts
    most = max(1, min(BLOCK_VECTORS, BLOCK_BYTES // max(1, 4 * length)))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table.column(c).chunk(0)
            numbers = whole_numbers(column("embedding"), length)
            trees = [Tree.grow(numbers[:, p * width : (p + 1) * width]).packed() for p in range(parts)]
            whole = pa.array([0, table.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(whole, column("vec_id")), pa.ListArray.from_arrays(whole, column("label")),
                 pa.array([trees], pa.list_(pa.binary()))], names=["vec_id", "label", "trees"])

        held, n = [], 0
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                some = batch.slice(begin, most - n)
                held.append(some)
                begin, n = begin + some.num_rows, n + some.num_rows
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.select("vec_id", "label", "embedding").mapInArrow(grown, f"vec_id array<bigint>, label array<{kind}>, trees array<binary>")


def _cut(codebooks: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The codebook of a part position: some columns of the entries, which have the length of a vector."""
    width = codebooks.shape[1] // parts
    return codebooks[:, part * width : (part + 1) * width]


def next_codebooks(trees: DataFrame, codebooks: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Codebooks after one round. What comes back is as long as the codebooks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, len(codebooks)), dtype=np.int64), np.zeros(codebooks.shape, dtype=np.int64)
        for batch in batches:
            for block in batch.column("trees"):
                for part, raw in enumerate(block):
                    n_here, sums_here = Tree.unpacked(raw.as_py()).statistics(_cut(codebooks, part, parts))
                    n[part] += n_here
                    _cut(sums, part, parts)[:] += sums_here
        rows = [(part, entry, n[part, entry], _cut(sums, part, parts)[entry].tolist())
                for part, entry in zip(*np.nonzero(n))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "entry", "n", "sums"])

    found = trees.select("trees").mapInArrow(added, "part int, entry int, n long, sums array<bigint>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "sum"))
    out = codebooks.copy()
    for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("total")).collect():
        _cut(out, r.part, parts)[r.entry, r.place] = r.total // r.n
    return out


def coded(trees: DataFrame, codebooks: np.ndarray, kind: str, parts: int = PARTS) -> DataFrame:
    """`vec_id`, `label` (of type `kind`), `code` and `error` of every vector in the blocks."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vec_ids, labels = (batch.column(c)[k].values for c in ("vec_id", "label"))
                found = [Tree.unpacked(raw.as_py()).codes(_cut(codebooks, part, parts))
                         for part, raw in enumerate(batch.column("trees")[k])]
                digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [vec_ids, labels, pa.array(codes, pa.string()), pa.array(sum(error for _, error in found))],
                    names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(assigned, f"vec_id long, label {kind}, code string, error long")


def codebook_text(codebooks: np.ndarray, parts: int = PARTS) -> str:
    """All components in decimal, by part, entry and place."""
    return ",".join(str(x) for part in range(parts) for x in _cut(codebooks, part, parts).reshape(-1).tolist())


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """`vec_id`, `code`, `error`, `label_error`, `codebooks_sha256` for each kept row of `vectors` (`vec_id`, `embedding`, `label`)."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    spark = vectors.sparkSession
    rows = usable(vectors)
    kind = dict(rows.dtypes)["label"]
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not length:  # no vector has a component
        nothing = hashlib.sha256(b"").hexdigest()
        return rows.select("vec_id", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit(nothing).alias("codebooks_sha256"))
    codebooks = whole_numbers(pa.array([r.embedding for r in first], pa.list_(pa.float64())), length)
    trees = stored(grow_trees(rows, length, parts), "cover-trees")
    for _ in range(rounds):
        codebooks = next_codebooks(trees, codebooks, parts)
    found = stored(coded(trees, codebooks, kind, parts), "vector-codes")
    errors = found.groupBy(F.col("label").alias("e_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebook_text(codebooks, parts).encode()).hexdigest()
    return found.join(errors, found["label"].eqNullSafe(errors["e_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
