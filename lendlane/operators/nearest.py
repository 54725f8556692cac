"""The k nearest neighbours between two tables of vectors.

The caller names the way:

* `blocks` (the default, exact, for a corpus of any size): the corpus is cut into
  cells around pivots and the cells into blocks of bounded size. A query visits
  only cells that can hold one of its neighbours (triangle inequality). Runs of
  blocks make up `SLICES` slices, or more where one would outgrow `SLICE_BYTES`; a
  task holds a slice, and the packs of queries that visit it stream past. So what is
  shuffled grows with the rows, not with the pairs: a query travels once for each slice.
  Slices are repeated under several salts, so that one every pack visits is
  searched by several tasks. Per pack and slice only k rows per query leave the task.
  Where cells leave out little (vectors do not cluster), a corpus cut by cells gains nothing: then tasks
  hold it as it is stored, nothing of it is shuffled, and all packs of queries stream past (`_by_scan`).
* `broadcast` (exact, for a corpus known to be small): a broadcast matrix, one
  narrow pass over the queries, no shuffle. The corpus is counted first, and one
  that is too large is refused.

Both give the same rows: ranked by distance to nine places, then by id. Where an
exact search costs too much, `operators/hashed_nearest.py` finds most of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lendlane.session import shared_folder

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 1024
PACK_ROWS = 256
BLOCK_COPIES = 4
# Pivots by default: the square root of the corpus, between these.
PIVOTS = (16, 1024)
# Slices of the corpus, if it has as many blocks, and the bytes of vectors of the largest.
SLICES = 32
SLICE_BYTES = 32 << 20
# Slots are dealt out to so many tasks at most.
MOST_TASKS = 1024
_PLACES = 9
# Corpus rows and products of a tile, columns whose least product stands for all, and pairs measured at once.
_TILE_ROWS, _TILE = 8192, 1 << 21
_FOLD = 32
_MEASURED = 1 << 15
_ROWS_AT_ONCE = 2048
# Of a scan: bytes of vectors a task holds, queries of a pack and of a part of it whose matches are put together, bytes
# of packs that one task meets, matches merged at once. A corpus is scanned if so many of its rows are to be visited, as found on so many queries.
SCAN_BYTES = 20 << 20
SCAN_PACK, SCAN_PART = 4096, 256
SCAN_QUERY_BYTES = 8 << 20
_MERGED, _MERGED_SLICES = 1 << 18, 4
_SCAN_FROM, _SCAN_SAMPLE = 0.5, 256
# Single precision is used below this square of a length, and if it leaves less than this share of a tile.
_NARROW_MOST, _NARROW_SHARE = 1e30, 1 / 8


def _floating(df: DataFrame, vector: str) -> Column:
    """The vectors as floats or doubles; others become doubles."""
    kind = df.schema[vector].dataType.elementType
    known = isinstance(kind, (T.FloatType, T.DoubleType))
    return F.col(vector) if known else F.transform(F.col(vector), lambda x: x.cast("double")).alias(vector)


def _small(batches):
    """The rows of batches, few at a time: a matrix of their distances to all pivots is to stay small."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS_AT_ONCE):
            yield b.slice(at, _ROWS_AT_ONCE)


def _raw_type(df: DataFrame, vector: str) -> str:
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _cells(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, and the distance to it."""
    squares = (-2.0 * rows) @ centres.T
    squares += (centres * centres).sum(1)
    cell = squares.argmin(1)
    return cell, np.sqrt(np.maximum(squares[np.arange(len(cell)), cell] + (rows * rows).sum(1), 0.0))


class _Rows:
    """Corpus rows with what each search needs: the squares of their lengths, `narrow`, rows and squares in single precision (None
    beyond its range), and `room` for a tile, which would cost much to take anew each time."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.squares, self.narrow = vectors, np.einsum("ij,ij->i", vectors, vectors), None
        self.room = np.empty(_TILE, dtype=np.float32)
        if len(vectors) and self.squares.max() < _NARROW_MOST:
            self.narrow = np.empty((len(vectors), vectors.shape[1] + 1), dtype=np.float32)
            self.narrow[:, :-1], self.narrow[:, -1] = vectors, self.squares

    def __len__(self):
        return len(self.vectors)

    def take(self, rows: np.ndarray) -> "_Rows":
        out = object.__new__(_Rows)
        out.vectors, out.squares, out.room = self.vectors[rows], self.squares[rows], self.room
        out.narrow = None if self.narrow is None else self.narrow[rows]
        return out


def _candidates(queries: np.ndarray, corpus: _Rows, reach: int):
    """Row numbers (query, corpus) that hold the `reach` closest of every query, and some more: by a matrix product, tile by tile.

    In single precision, with as much slack as it may be wrong by; in double precision where that leaves too many.
    """
    q_most, c_most = (queries * queries).sum(1).max(), corpus.squares.max()
    slack = 1e-8 * (1.0 + q_most + c_most)
    if corpus.narrow is not None and q_most < _NARROW_MOST:
        # Sums of so many products, each rounded; 2|q||c| is at most |q|^2 + |c|^2.
        wrong = (queries.shape[1] + 8) * 2.0 ** -24 * (q_most + 2.0 * c_most)
        asked = np.ones((len(queries), queries.shape[1] + 1), dtype=np.float32)
        asked[:, :-1] = -2.0 * queries

        def square(at):
            some = corpus.narrow[at:at + _TILE_ROWS]
            return np.matmul(asked, some.T, out=corpus.room[:len(asked) * len(some)].reshape(len(asked), len(some)))

        found = _within(len(queries), len(corpus), square, reach, np.float32(slack + 2.0 * wrong), _NARROW_SHARE)
        if found is not None:
            return found

    def wide(at):
        tile = (-2.0 * queries) @ corpus.vectors[at:at + _TILE_ROWS].T
        tile += corpus.squares[at:at + _TILE_ROWS]
        return tile

    return _within(len(queries), len(corpus), wide, reach, slack)


def _within(queries: int, rows: int, squares, reach: int, slack, share: float = math.inf):
    """Row numbers of the `reach` least squares of every query and all that are larger by `slack` at most; None if they are more than `share` of a tile.

    The least squares of as many groups of columns are a bound on the squares wanted; it falls from tile to tile, and only
    groups within it are looked at.
    """
    best = None
    found = []
    for at in range(0, rows, _TILE_ROWS):
        square = squares(at)
        columns = square.shape[1] // _FOLD
        grouped = columns * _FOLD if columns >= reach else 0
        rest = square[:, grouped:]
        least = rest
        if grouped:
            folded = square[:, :grouped].reshape(queries, _FOLD, columns).min(1)
            least = np.concatenate([folded, rest], axis=1)
        best = np.full((queries, reach), np.inf, dtype=square.dtype) if best is None else best
        best = np.partition(np.concatenate([best, least], axis=1), reach - 1, axis=1)[:, :reach]
        bound = best.max(1) + slack
        q, c = np.nonzero(rest <= bound[:, None])
        c += grouped
        if grouped:
            group_q, group = np.nonzero(folded <= bound[:, None])
            each = (group[:, None] + columns * np.arange(_FOLD)).ravel()
            group_q = np.repeat(group_q, _FOLD)
            near = square[group_q, each] <= bound[group_q]
            q, c = np.concatenate([q, group_q[near]]), np.concatenate([c, each[near]])
        if len(q) > share * square.size + reach * queries:
            return None
        found.append((q, c + at, square[q, c]))
    q, c, square = (np.concatenate(x) for x in zip(*found))
    near = square <= bound[q]
    return q[near], c[near]


def _closest(queries: np.ndarray, corpus: _Rows, same: tuple | None, k: int, id_order: np.ndarray | None = None):
    """Row numbers (query, corpus), exact distances and ranks of the k closest. Equal distances are in the order of
    `id_order`, by default that of the rows.

    A matrix product finds everything within reach of the k-th distance; only that is measured exactly. `same` marks the
    rows to skip: a number for each query, a number for each corpus row (equal ones are not to meet), and how many rows
    have the same number at most.
    """
    reach = k if same is None else k + same[2]
    step = max(1, _TILE // max(1, min(len(corpus), _TILE_ROWS)))
    for at in range(0, len(queries), step):
        part = queries[at:at + step]
        if reach < len(corpus):
            q, c = _candidates(part, corpus, reach)
        else:
            q, c = (x.ravel() for x in np.indices((len(part), len(corpus))))
        if same is not None:
            keep = same[0][at + q] != same[1][c]
            q, c = q[keep], c[keep]
        exact = np.empty(len(q))
        for i in range(0, len(q), _MEASURED):
            pairs = slice(i, i + _MEASURED)
            exact[pairs] = np.sqrt(((part[q[pairs]] - corpus.vectors[c[pairs]]) ** 2).sum(1))
        order = np.lexsort((c if id_order is None else id_order[c], np.round(exact, _PLACES), q))
        q, c, exact = q[order], c[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        yield q[top] + at, c[top], exact[top], rank[top] + 1


def _list(values: pa.Array) -> pa.Array:
    """One row: the list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _maybe_repeated(vectors: np.ndarray) -> np.ndarray:
    """Which rows have the same sum of their bits, weighted, as another one; rows that are equal to the bit have."""
    if not vectors.size:
        return np.ones(len(vectors), dtype=bool)
    bits = np.ascontiguousarray(vectors, dtype=np.float64).view(np.uint64)
    # Odd numbers far apart, so that rows seldom agree by chance; sums wrap around.
    weights = np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    _, number, times = np.unique(np.einsum("ij,j->i", bits, weights), return_inverse=True, return_counts=True)
    return times[number] > 1


class _Slice:
    """Corpus rows that queries meet: ids, vectors, carried columns; `blocks` tells the block of each row, `skip` marks ids to leave out.

    Of the rows with a query's own id, the last one of each block is left out, as if each block were asked by itself; all, if `whole_ids`.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, carried: list, blocks: np.ndarray, k: int, skip: bool, whole_ids: bool = False):
        by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy(zero_copy_only=False)
        order = by_id[np.argsort(blocks[by_id], kind="stable")]
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        # Codes of ids; a row that is never left out has one that no query has.
        encoded = ids.dictionary_encode(null_encoding="encode")
        code, self.known = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
        self.most = 0
        if skip and len(ids):
            c, b = code[order], blocks[order]
            last = np.append((c[1:] != c[:-1]) | (b[1:] != b[:-1]), True) | whole_ids
            code[order[~last]] = -2
            self.most = int(np.bincount(c[last]).max())
        # Of equal vectors only so many can be among the closest: those first in the order of ids.
        seen: dict = {}
        kept = np.ones(len(ids), dtype=bool)
        for i in by_id[_maybe_repeated(vectors)[by_id]].tolist():
            n = seen[raw] = seen.get(raw := vectors[i].tobytes(), 0) + 1
            kept[i] = n <= k + self.most
        order = order[kept[order]]
        taken = pa.array(order)
        self.ids, self.carried = ids.take(taken), [x.take(taken) for x in carried]
        self.vectors, self.place, self.code = _Rows(np.ascontiguousarray(vectors[order])), place[order], code[order]
        self.blocks = blocks[order]

    def rows(self, asked: np.ndarray | None) -> np.ndarray | None:
        """Numbers of the rows in the blocks asked for; None for all."""
        if asked is None:
            return None
        inside = np.isin(self.blocks, asked)
        return None if inside.all() else np.flatnonzero(inside)


@dataclass(frozen=True)
class _Task:
    k: int
    skip_same: bool
    names: list
    whole_ids: bool = False

    def slice(self, ids, vectors, carried, blocks=None):
        return _Slice(ids, vectors, carried, np.zeros(len(ids), dtype=np.int64) if blocks is None else blocks, self.k, self.skip_same, self.whole_ids)

    def match(self, query_ids, queries, held: _Slice, asked=None):
        """Record batches of matches between queries and a slice, or those of its blocks that are `asked`."""
        if not len(query_ids) or not len(held.ids):
            return
        rows = held.rows(asked)
        vectors, place, code = (held.vectors, held.place, held.code) if rows is None else (
            held.vectors.take(rows), held.place[rows], held.code[rows])
        if not len(vectors):
            return
        same = None
        if self.skip_same:
            own = pc.fill_null(pc.index_in(query_ids, value_set=held.known.cast(query_ids.type)), -1)
            same = own.to_numpy(zero_copy_only=False).astype(np.int64), code, held.most
        for q, c, distance, rank in _closest(queries, vectors, same, self.k, place):
            c = c if rows is None else rows[c]
            picked = [query_ids.take(pa.array(q)), pa.array(rank, pa.int32()), held.ids.take(pa.array(c)), pa.array(distance)]
            picked += [x.take(pa.array(c)) for x in held.carried]
            yield pa.RecordBatch.from_arrays(picked, names=self.names)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "query_id", corpus_id: str = "chunk_id",
            vector: str = "embedding", carry: tuple = (), skip_same: bool = False,
            way: str = "blocks", broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
            pack_rows: int = PACK_ROWS, pivots: int | None = None, block_copies: int = BLOCK_COPIES) -> DataFrame:
    """The k nearest corpus rows of every query: query id, `rank`, corpus id, `distance`, carried corpus columns.

    `skip_same` leaves out the corpus row that has the query's own id. The corpus
    is read more than once (for its count, its cells, its blocks): hand in a stored
    table, not one that is still to be computed.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id), _floating(queries, vector))
    c = corpus.where(F.col(vector).isNotNull()).select(F.col(corpus_id), _floating(corpus, vector), *carry)
    schema = T.StructType([
        T.StructField(query_id, q.schema[query_id].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField(corpus_id, c.schema[corpus_id].dataType), T.StructField("distance", T.DoubleType()),
        *[T.StructField(n, c.schema[n].dataType) for n in carry],
    ])
    task = _Task(k, skip_same, schema.names)
    if way == "broadcast":
        text_bytes = sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in (corpus_id, *carry)), F.lit(0))
        size = c.agg(F.sum(8 * F.size(vector) + text_bytes).alias("bytes")).first()["bytes"] or 0
        if size > broadcast_bytes:
            raise ValueError(f"a corpus of {size} bytes is too large to broadcast (limit {broadcast_bytes}): use blocks")
        return _by_broadcast(q, c, query_id, corpus_id, vector, carry, schema, task)
    if way != "blocks":
        raise ValueError(f"no such way: {way}")
    if pivots is None:
        pivots = min(max(math.isqrt(c.count()), PIVOTS[0]), PIVOTS[1])
    return _by_blocks(q, c, query_id, corpus_id, vector, carry, schema, task, block_rows, pack_rows, pivots, block_copies)


def _by_broadcast(q, c, query_id, corpus_id, vector, carry, schema, task) -> DataFrame:
    held = q.sparkSession.sparkContext.broadcast(c.orderBy(corpus_id).toArrow().combine_chunks())

    def search(batches):
        table = held.value
        column = lambda n: table.column(n).combine_chunks() if table.num_rows else pa.array([], table.schema.field(n).type)
        whole = task.slice(column(corpus_id), _vectors(column(vector)), [column(n) for n in carry])
        for b in batches:
            yield from task.match(b.column(query_id), _vectors(b.column(vector)), whole)

    return q.mapInArrow(search, schema)


def _visits(d: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray, wanted: int) -> np.ndarray:
    """Which cells can hold one of the `wanted` closest, for queries with distances `d` to the centres of cells.

    `n` members are between `near` and `far` of a centre.
    """
    # Some `wanted` members lie within the reach of the nearest cells that hold as many.
    reach = np.where(n > 0, d + far, np.inf)
    order = np.argsort(reach, axis=1)
    enough = (np.cumsum(n[order], axis=1) >= wanted).argmax(1)
    enough[n.sum() < wanted] = len(n) - 1
    row = np.arange(len(d))
    bound = reach[row, order[row, enough]]
    return (n > 0) & (np.maximum(d - far, near - d) <= bound[:, None] + 1e-6)


def _mostly_visited(some: DataFrame, vector: str, centres: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray, wanted: int) -> bool:
    """Whether the cells that some queries must visit hold most of the corpus."""
    asked = _vectors(some.select(vector).toArrow().column(vector).combine_chunks())
    if not len(asked):
        return False
    visited = _visits(_distances(asked, centres), n, near, far, wanted) @ n
    return visited.mean() >= _SCAN_FROM * n.sum()


def _by_blocks(q, c, query_id, corpus_id, vector, carry, schema, task, block_rows, pack_rows, pivots, block_copies) -> DataFrame:
    # A bounded number of pivots, picked by hash so that a rerun picks the same.
    picked = c.select(corpus_id, vector).orderBy(F.xxhash64(corpus_id), corpus_id).limit(pivots)
    centres = _vectors(picked.toArrow().column(vector).combine_chunks())
    if not len(centres):
        return q.sparkSession.createDataFrame([], schema)

    def measured(batches):
        for b in _small(batches):
            if b.num_rows:
                cell, d = _cells(_vectors(b.column(vector)), centres)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(d), pc.list_value_length(b.column(vector))],
                    names=["cell", "centre_distance", "width"])

    # One row per pivot comes back: how many members, how near and how far they are.
    stats = c.select(vector).mapInArrow(measured, "cell int, centre_distance double, width int").groupBy("cell").agg(
        F.count("*").alias("n"), F.min("centre_distance").alias("near"), F.max("centre_distance").alias("far"), F.max("width").alias("width")
    ).collect()
    n = np.zeros(len(centres), dtype=np.int64)
    near, far = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for s in stats:
        n[s["cell"]], near[s["cell"]], far[s["cell"]] = s["n"], s["near"], s["far"]
    parts = -(-n // block_rows)
    first_block = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)
    wanted = task.k + (1 if task.skip_same else 0)
    # Where a query's own id is skipped, which of repeated ids is skipped goes by blocks.
    if not task.skip_same and _mostly_visited(q.limit(_SCAN_SAMPLE), vector, centres, n, near, far, wanted):
        return _by_scan(q, c, query_id, corpus_id, vector, carry, schema, task)

    # Slices are runs of blocks with about as many rows each.
    rows, width = int(n.sum()), max((s["width"] for s in stats), default=1)
    slices = max(1, min(SLICES, -(-rows // block_rows)), -(-rows * width * 8 // SLICE_BYTES))
    in_block = np.repeat(n / np.maximum(parts, 1), parts)
    slice_of = np.minimum((np.cumsum(in_block) - in_block / 2) * slices / max(1, rows), slices - 1).astype(np.int64)
    cell_of = np.repeat(np.arange(len(n)), parts)

    def to_blocks(batches):
        for b in _small(batches):
            if not b.num_rows:
                continue
            values = _vectors(b.column(vector))
            cell, _ = _cells(values, centres)
            # A crowded cell is split by the hash of the id, so no block outgrows its bound.
            block = first_block[cell] + b.column("id_hash").to_numpy() % np.maximum(parts[cell], 1)
            for at in np.unique(slice_of[block]).tolist():
                some = np.flatnonzero(slice_of[block] == at)
                taken = b.take(pa.array(some))
                yield corpus_pack([at], block[some], taken.column(corpus_id), values[some], [taken.column(x) for x in carry])

    def to_packs(batches):
        for b in _small(batches):
            if not b.num_rows:
                continue
            values = _vectors(b.column(vector))
            d = _distances(values, centres)
            visit = _visits(d, n, near, far, wanted)
            # Queries around the same pivot share a pack, so they want much the same cells.
            by_cell = np.argsort(d.argmin(1), kind="stable")
            for at in range(0, len(by_cell), pack_rows):
                chosen = by_cell[at:at + pack_rows]
                cells = np.flatnonzero(visit[chosen].any(0))
                blocks = np.flatnonzero(np.isin(cell_of, cells))
                yield query_pack(np.unique(slice_of[blocks]).tolist(), cells, b.column(query_id).take(pa.array(chosen)), values[chosen])

    shape, corpus_pack, query_pack = packing(q, c, query_id, corpus_id, vector, carry)
    blocks = c.withColumn("id_hash", F.xxhash64(corpus_id)).mapInArrow(to_blocks, shape)
    packs = q.mapInArrow(to_packs, shape)
    # The salt of a pack comes from its first query, so a rerun picks the same one.
    salt = F.pmod(F.xxhash64(F.col("q_ids")[0]), F.lit(block_copies)).cast("int")
    slot = F.explode(F.transform("slices", lambda x: x * block_copies + F.col("salt"))).alias("slot")
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(block_copies - 1)))), packs.withColumn("salt", salt)
    both = salted[0].select(slot, *shape.names[1:]).unionByName(salted[1].select(slot, *shape.names[1:]))
    found = met(both, slices * block_copies, schema, task, _raw_type(q, vector), _raw_type(c, vector), len(carry), cell_of)
    closest = Window.partitionBy(query_id).orderBy(F.round("distance", _PLACES), corpus_id)
    return found.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= task.k).select(*schema.names)


def packing(q: DataFrame, c: DataFrame, query_id: str, corpus_id: str, vector: str, carry: tuple = ()):
    """The shape of packed rows, and functions that make one of corpus rows and one of queries.

    A packed row goes to the slices it lists. `marks` are the blocks of corpus rows, or the cells that queries ask for.
    """
    types = [q.schema[query_id].dataType, c.schema[corpus_id].dataType]
    shape = T.StructType([
        T.StructField("slices", T.ArrayType(T.IntegerType())), T.StructField("side", T.IntegerType()),
        T.StructField("marks", T.ArrayType(T.IntegerType())), T.StructField("q_ids", T.ArrayType(types[0])),
        T.StructField("c_ids", T.ArrayType(types[1])), T.StructField("vectors", T.BinaryType()),
        *[T.StructField(f"carried_{i}", T.ArrayType(c.schema[x].dataType)) for i, x in enumerate(carry)],
    ])
    names, n_carried, q_raw, c_raw = shape.names, len(carry), _raw_type(q, vector), _raw_type(c, vector)
    arrow = to_arrow_schema(shape)

    def pack(slices, side, marks, q_ids, c_ids, raw, carried):
        empty = lambda name: pa.nulls(1, arrow.field(name).type)
        return pa.RecordBatch.from_arrays([
            _list(pa.array(slices, pa.int32())), pa.array([side], pa.int32()), _list(pa.array(np.asarray(marks), pa.int32())),
            empty("q_ids") if q_ids is None else _list(q_ids), empty("c_ids") if c_ids is None else _list(c_ids), pa.array([raw], pa.binary()),
            *[empty(f"carried_{i}") if carried is None else _list(carried[i]) for i in range(n_carried)]], names=names)

    def corpus_pack(slices, blocks, ids, values, carried=()):
        return pack(slices, 0, blocks, None, ids, values.astype(c_raw).tobytes(), carried)

    def query_pack(slices, cells, ids, values):
        return pack(slices, 1, cells, ids, None, values.astype(q_raw).tobytes(), None)

    return shape, corpus_pack, query_pack


def met(packed: DataFrame, slots: int, schema: T.StructType, task: _Task, q_raw: str, c_raw: str, n_carried: int,
        cell_of: np.ndarray | None = None, tables_of: np.ndarray | None = None,
        tasks: int = MOST_TASKS) -> DataFrame:
    """Matches between the corpus rows and the queries packed under the same `slot`, of which there are `slots`.

    A task holds the corpus rows of one slot at a time; the queries stream past. `cell_of` tells the cell of each block; without it
    queries meet all rows of their slot. With `tables_of`, the table of each slot leads the matches.
    """
    def search(batches):
        slot, gathered, held = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                now = b.column("slot")[i].as_py()
                if now != slot:
                    slot, gathered, held = now, [], None
                raw = b.column("vectors")[i].as_buffer()
                if b.column("side")[i].as_py() == 0:
                    # Copied out, so that the batch can go.
                    row = [b.column("marks")[i], b.column("c_ids")[i], *[b.column(f"carried_{x}")[i] for x in range(n_carried)]]
                    values = np.frombuffer(raw, dtype=c_raw).astype(np.float64).reshape(len(row[1].values), -1)
                    gathered.append(([pa.concat_arrays([x.values]) for x in row], values))
                    continue
                if not gathered and held is None:
                    continue  # no corpus rows here
                if held is None:
                    columns = [pa.concat_arrays(list(x)) for x in zip(*[row for row, _ in gathered])]
                    marks = columns[0].to_numpy(zero_copy_only=False).astype(np.int64)
                    held = task.slice(columns[1], np.concatenate([v for _, v in gathered]), columns[2:], marks)
                    if cell_of is not None:
                        held.blocks = cell_of[held.blocks]
                    gathered = []
                ids = b.column("q_ids")[i].values
                values = np.frombuffer(raw, dtype=q_raw).astype(np.float64).reshape(len(ids), -1)
                asked = None if cell_of is None else b.column("marks")[i].values.to_numpy(zero_copy_only=False)
                for found in task.match(ids, values, held, asked):
                    if tables_of is not None:
                        table = pa.array(np.full(found.num_rows, tables_of[slot]), pa.int32())
                        found = pa.RecordBatch.from_arrays([table, *found.columns], names=schema.names)
                    yield found

    tasks = min(slots, tasks)
    dealt = packed.repartitionById(tasks, F.pmod(F.col("slot"), F.lit(tasks)).cast("int")).sortWithinPartitions("slot", "side")
    return dealt.mapInArrow(search, schema)


def _coded(values: np.ndarray) -> bytes:
    """A matrix as bits that tell where it is not zero, and what is there."""
    held = values != 0
    return np.packbits(held).tobytes() + values[held].tobytes()


def _decoded(raw: pa.Buffer, rows: int, width: int, kind: str) -> np.ndarray:
    bits = -(-rows * width // 8)
    held = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=bits), count=rows * width).astype(bool)
    values = np.zeros(rows * width)
    values[held] = np.frombuffer(raw[bits:], dtype=kind)
    return values.reshape(rows, width)


def _best(batches: list, k: int) -> pa.RecordBatch:
    """Of matches (row of a query in its pack, query id, corpus id, distance, carried columns), the k closest of every row."""
    all_of = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    row, ids, distance = (all_of.column(i) for i in (0, 2, 3))
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy(zero_copy_only=False)] = np.arange(len(ids))
    row = row.to_numpy(zero_copy_only=False)
    order = np.lexsort((place, np.round(distance.to_numpy(zero_copy_only=False), _PLACES), row))
    row = row[order]
    return all_of.take(pa.array(order[np.arange(len(row)) - np.searchsorted(row, row) < k]))


def _by_scan(q, c, query_id, corpus_id, vector, carry, schema, task) -> DataFrame:
    """Every query meets the whole corpus, which is not shuffled: a task holds a slice of it after another, as it is stored, and the packs
    of queries, which are stored too, stream past. Matches are put together by parts of packs: a row for each part and task is shuffled.
    """
    spark = q.sparkSession
    q_raw, c_raw = _raw_type(q, vector), _raw_type(c, vector)
    kinds = schema[query_id].dataType, schema[corpus_id].dataType, *(schema[x].dataType for x in carry)
    n_carried, k, names = len(carry), task.k, schema.names
    # Vectors lie in pieces of so many rows.
    sizes = [T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("width", T.IntegerType()), T.StructField("vectors", T.ArrayType(T.BinaryType()))]
    pack_shape = T.StructType([T.StructField("q_ids", T.ArrayType(kinds[0])), *(T.StructField(f"q_{x.name}", x.dataType) for x in sizes)])
    slice_shape = T.StructType([
        T.StructField("slice", T.IntegerType()), T.StructField("c_ids", T.ArrayType(kinds[1])),
        *(T.StructField(f"carried_{i}", T.ArrayType(kind)) for i, kind in enumerate(kinds[2:])), *sizes])
    match_shape = T.StructType([T.StructField("part", T.LongType()), *(T.StructField(x, T.ArrayType(kind)) for x, kind in [
        ("q_ids", kinds[0]), ("row", T.IntegerType()), ("c_ids", kinds[1]), ("distance", T.DoubleType()),
        *((f"carried_{i}", kind) for i, kind in enumerate(kinds[2:]))])])
    # A row of a part stands for its query, since ids may repeat.
    matches = ["row", "rank", "c_ids", "distance", *match_shape.names[5:]]
    by_row = _Task(k, False, matches)

    def gathered(batches, columns, raw, most_rows):
        """Columns, numbers of rows and coded vectors of runs of rows of a task, as many as a pack or slice holds; copied out, so that the batches can go."""
        held, count = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                width = max(1, len(b.column(vector)[0]))
                take = min(b.num_rows - at, most_rows(width) - count)
                some = pa.array(np.arange(at, at + take))
                values = _vectors(b.column(vector).slice(at, take)).astype(raw, copy=False)
                held.append(([b.column(x).take(some) for x in columns], values.shape, _coded(values)))
                at, count = at + take, count + take
                if count >= most_rows(width):
                    yield held
                    held, count = [], 0
        if held:
            yield held

    def as_row(held, extra):
        columns = [pa.concat_arrays(list(x)) for x in zip(*[row for row, _, _ in held])]
        n, raw = pa.array([shape[0] for _, shape, _ in held], pa.int32()), pa.array([x for *_, x in held], pa.binary())
        return [*extra, *(_list(x) for x in columns), _list(n), pa.array([held[0][1][1]], pa.int32()), _list(raw)]

    def vectors_of(n, width, raw, kind):
        return np.concatenate([_decoded(x.as_buffer(), rows.as_py(), width.as_py(), kind) for rows, x in zip(n.values, raw.values)])

    def to_packs(batches):
        for held in gathered(batches, [query_id], q_raw, lambda width: SCAN_PACK):
            yield pa.RecordBatch.from_arrays(as_row(held, []), names=pack_shape.names)

    def to_slices(batches):
        for i, held in enumerate(gathered(batches, [corpus_id, *carry], c_raw, lambda width: max(1, SCAN_BYTES // (8 * width)))):
            yield pa.RecordBatch.from_arrays(as_row(held, [pa.array([i], pa.int32())]), names=slice_shape.names)

    folder = shared_folder(spark, "questions")
    q.mapInArrow(to_packs, pack_shape).write.parquet(folder)
    stored = spark.read.schema(pack_shape).parquet(folder)
    length = F.aggregate("q_vectors", F.lit(0), lambda total, x: total + F.octet_length(x))
    size = stored.agg(F.sum(length)).first()[0] or 0
    # The rows of a partition are numbered, and the partition above them.
    number = F.monotonically_increasing_id()
    packs = stored.coalesce(-(-size // SCAN_QUERY_BYTES) or 1).withColumn("pack", number).withColumn(
        "first", F.col("pack").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    # A task goes through the packs of a partition for each of its slices, so it is enough that the slice comes along with the first.
    once = [F.when(F.col("first"), F.col(x)).alias(x) for x in slice_shape.names if x != "slice"]
    pairs = c.mapInArrow(to_slices, slice_shape).hint("shuffle_replicate_nl").crossJoin(packs)
    both = pairs.select("slice", "pack", "q_ids", "q_n", "q_width", "q_vectors", *once)

    def search(batches):
        now = held = None
        # By part: the ids of its queries, and their closest so far.
        best: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                at = {x: b.column(x)[i] for x in b.schema.names}
                if at["c_ids"].is_valid:
                    now, held = at["slice"], None
                    carried = [pa.concat_arrays([at[f"carried_{x}"].values]) for x in range(n_carried)]
                    held = task.slice(at["c_ids"].values, vectors_of(at["n"], at["width"], at["vectors"], c_raw), carried)
                if held is None or now != at["slice"]:
                    raise RuntimeError("a pack of queries came before its slice")
                q_ids = at["q_ids"].values
                values = vectors_of(at["q_n"], at["q_width"], at["q_vectors"], q_raw)
                for first in range(0, len(q_ids), SCAN_PART):
                    some = values[first:first + SCAN_PART]
                    number = at["pack"].as_py() * SCAN_PACK + first
                    if number not in best:
                        best[number] = q_ids.take(pa.array(np.arange(first, first + len(some)))), []
                    found = best[number][1]
                    found += by_row.match(pa.array(np.arange(len(some)), pa.int32()), some, held)
                    if len(found) > _MERGED_SLICES:
                        found[:] = [_best(found, k)]
            # The batch is not to be held while the next one is read.
            b = at = q_ids = None
        for number, (q_ids, found) in best.items():
            if found:
                row, _, c_ids, distance, *carried = _best(found, k).columns
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(_list(x) for x in (q_ids, row, c_ids, distance, *carried))], names=match_shape.names)

    def merge(batches):
        part, q_ids, found, count = None, None, [], 0

        def closest():
            row, _, c_ids, distance, *carried = _best(found, k).columns
            rank = row.to_numpy(zero_copy_only=False)
            rank = np.arange(len(rank)) - np.searchsorted(rank, rank) + 1
            return pa.RecordBatch.from_arrays([q_ids.take(row), pa.array(rank, pa.int32()), c_ids, distance, *carried], names=names)

        for b in batches:
            for i in range(b.num_rows):
                number, ids, row, *columns = (b.column(x)[i] for x in match_shape.names)
                if number.as_py() != part:
                    if found:
                        yield closest()
                    part, q_ids, found, count = number.as_py(), ids.values, [], 0
                found.append(pa.RecordBatch.from_arrays([row.values, row.values, *(x.values for x in columns)], names=matches))
                count += len(row.values)
                if count > _MERGED:
                    found, count = [_best(found, k)], 0
        if found:
            yield closest()

    found = both.mapInArrow(search, match_shape).repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)
    closest = Window.partitionBy(query_id).orderBy(F.round("distance", _PLACES), corpus_id)
    return found.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k).select(*names)
