"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

Documents are never cut unless they are longer than a sequence. Pieces are dealt
at random to shards of bounded size, and each shard is packed in one task:

1. Large lengths are sorted and cut into groups of equal cardinality; each
   length counts as the largest of its group, so only a few sizes remain.
2. How often to use which configuration of these sizes is a linear programme, solved by generating
   configurations: the prices of the sizes ask, as a knapsack, for the best configuration not used yet, until none is worth more
   than a sequence, to within `GAP`.
3. Actual pieces take the places of their group, which gives back what rounding up cost; the last place of a sequence goes to the
   largest piece that fits, or to its group.
4. What is left, small pieces above all, goes largest first to the sequence that it fits best. Sequences with much
   room are opened again and their pieces placed anew, as long as that needs no more sequences.

What counts as large is tried at several shares of a sequence, and what needs fewest sequences is kept. Over half a sequence, a
configuration is one size, and the rest is best fit alone: so no shard needs more sequences than best fit does.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import kept_by_worker, stored
from lendlane.llm.word_bpe import TEXTS_AT_ONCE, WordBpe, with_end

CAPACITY = 2048
# Pieces in a shard. Each shard may end with a sequence that is not full.
SHARD_PIECES = 1 << 16
# Sizes that remain after grouping, and the shares of a sequence up to which a piece is small that are tried.
GROUPS = 64
SMALL_SHARES = (1 / 8, 1 / 4, 1 / 2)
# How far above the least possible number of sequences, as a share, the configurations may stay.
GAP = 5e-4
# Sequences with more room than these shares are opened again, one share after the other.
REOPENED = (1 / 2, 1 / 8, 1 / 32, 1 / 128)


def dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest price: how often it has each size. A knapsack, by capacity."""
    worth = np.zeros((len(sizes) + 1, capacity + 1))
    for g, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist())):
        now = worth[g].copy()
        if price > 0:
            for _ in range(capacity // size):
                np.maximum(now[size:], now[:-size] + price, out=now[size:])
        worth[g + 1] = now
    chosen, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for g in range(len(sizes) - 1, -1, -1):
        while worth[g + 1][room] > worth[g][room] + 1e-12:
            chosen[g] += 1
            room -= int(sizes[g])
    return float(worth[-1][capacity]), chosen


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Configurations of ascending sizes and how often to use each, in fractions, so that each size occurs as often as it counts."""
    fits = capacity // sizes
    found = list(np.diag(fits))
    inverse, times = np.diag(1 / fits), counts / fits
    bound = 0.0
    while True:
        prices = inverse.sum(axis=0)
        worth, chosen = dearest(sizes, prices, capacity)
        bound = max(bound, times.sum() / worth)  # no packing of these sizes needs less
        if worth <= 1 + 1e-9 or bound >= times.sum() * (1 - gap):
            return [(c, float(t)) for c, t in zip(found, times) if t > 1e-9]
        # It replaces the configuration that it uses up first.
        change = inverse @ chosen
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        times = np.maximum(times - step * change, 0)
        times[out] = step
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        found[out] = chosen


def substituted(lengths: np.ndarray, large: np.ndarray, sizes: np.ndarray, used: list[tuple[np.ndarray, float]], capacity: int,
                free_last: bool) -> tuple[np.ndarray, list[int]]:
    """Actual pieces in the places of configurations: a sequence for each (-1: none yet), and the room of each sequence.

    The configurations of the largest sizes come first. A place takes the largest piece up to its group's size; the last one, if
    `free_last`, the largest that fits.
    """
    sequence, room = np.full(len(lengths), -1, dtype=np.int64), []
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit n: a piece of n tokens is left
    for i, n in zip(large.tolist(), lengths[large].tolist()):
        by_length[n].append(i)
        some |= 1 << n
    below = [0, *sizes[:-1].tolist()]
    for configuration, times in sorted(used, key=lambda c: -int(np.flatnonzero(c[0])[-1])):
        places = np.repeat(np.arange(len(sizes)), configuration)[::-1].tolist()
        for _ in range(math.ceil(times - 1e-6)):
            if not (some & ((1 << (int(sizes[places[0]]) + 1)) - 1)) >> (below[places[0]] + 1):
                break  # its largest group is used up
            free = capacity
            for k, group in enumerate(places):
                limit = free if free_last and k == len(places) - 1 else min(free, int(sizes[group]))
                fitting = some & ((1 << (limit + 1)) - 1)
                if not fitting:
                    break
                n = fitting.bit_length() - 1
                sequence[by_length[n].pop()] = len(room)
                if not by_length[n]:
                    some ^= 1 << n
                free -= n
            room.append(free)
    return sequence, room


def best_fit(lengths: np.ndarray, order: np.ndarray, room: list[int], sequence: np.ndarray, capacity: int) -> None:
    """Give each piece in `order` to the open sequence with least room that is enough, or to a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a sequence has r tokens of room
    for s, r in enumerate(room):
        by_room[r].append(s)
        some |= 1 << r
    for i in order.tolist():
        n = int(lengths[i])
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            s = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            s, r = len(room), capacity
            room.append(capacity)
        sequence[i] = s
        room[s] = r - n
        by_room[r - n].append(s)
        some |= 1 << (r - n)


def reopened(lengths: np.ndarray, order: np.ndarray, sequence: np.ndarray, room: list[int], capacity: int) -> tuple[np.ndarray, list[int]]:
    """The same or fewer sequences, after placing the pieces of loosely filled ones anew."""
    for share in REOPENED:
        loose = np.array(room) > capacity * share
        if loose.any():
            number = np.where(loose, -1, np.cumsum(~loose) - 1)
            again, rest = number[sequence], [r for r, is_loose in zip(room, loose.tolist()) if not is_loose]
            best_fit(lengths, order[again[order] < 0], rest, again, capacity)
            if len(rest) <= len(room):
                sequence, room = again, rest
    return sequence, room


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS,
                 small_shares: tuple = SMALL_SHARES) -> tuple[np.ndarray, np.ndarray]:
    """A sequence and an offset for each length; every length is between 1 and `capacity`."""
    ascending = np.argsort(lengths, kind="stable")
    least: tuple[np.ndarray, list[int]] | None = None
    for share in small_shares:
        large = ascending[lengths[ascending] > capacity * share]
        sizes, used = np.empty(0, dtype=np.int64), []
        if len(large):
            cut = np.array_split(large, min(groups, len(large)))
            # Rounded up to the largest of the group; groups of one size are one.
            sizes, group = np.unique([lengths[g[-1]] for g in cut], return_inverse=True)
            used = configurations(sizes, np.bincount(group, [len(g) for g in cut]), capacity)
        for free_last in (True, False) if 2 * capacity * share < capacity else (False,):
            sequence, room = substituted(lengths, large, sizes, used, capacity, free_last)
            best_fit(lengths, ascending[::-1][sequence[ascending[::-1]] < 0], room, sequence, capacity)
            sequence, room = reopened(lengths, ascending[::-1], sequence, room, capacity)
            if least is None or len(room) < len(least[1]):
                least = sequence, room
    sequence = least[0]
    by_sequence = np.argsort(sequence, kind="stable")
    ends = np.cumsum(lengths[by_sequence])
    firsts = np.flatnonzero(np.diff(sequence[by_sequence], prepend=-1))
    starts = ends - lengths[by_sequence]
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[by_sequence] = starts - np.repeat(starts[firsts], np.diff([*firsts, len(lengths)]))
    return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The token ids of each document and its end, cut only where they exceed a sequence.

    One row per piece. A document without text is one piece that holds the end id only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(f"bpe {vocabulary}", lambda: WordBpe(vocabulary))
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(begin, TEXTS_AT_ONCE)
                ids, counts = with_end(*bpe.encode_arrays(some.column("text")), end_id)
                n_pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(counts[owner] - start, capacity)
                raw, ends = memoryview(ids).cast("B"), (4 * np.cumsum(length)).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add `sequence_id` and `offset` to stored pieces. Which sequence a piece is in may change with the stored files."""
    shards = max(1, -(-cut.count() // shard_pieces))
    # Dealt by row, not by document, so that repeated rows do not meet in one shard.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # The same pieces give the same packing in whatever order they arrive.
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], kind="stable", ignore_index=True)
        sequence, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="shard").assign(sequence_id=(int(key[0]) << 40) + sequence, offset=offset)

    return dealt.groupBy("shard").applyInPandas(packed, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of `docs` (`doc_id`, `text`) with their sequence and their place in it. No documents, no pieces."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity, shard_pieces)
