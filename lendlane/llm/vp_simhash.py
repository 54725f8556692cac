"""SimHash near-duplicates, found exactly by vantage-point trees over Hamming distance.

Equal fingerprints are one point. A vantage-point tree, grown from a
sample of points, deals all points to shards: at each node, points within the
node's radius of its vantage point go inside, the others outside. A point is
kept in one shard. Of two near points that part at a node, the outer one asks for
its neighbours inside, and its question follows every branch that the triangle
bound cannot rule out. Shards are large, so that a point asks in few others; one that many
ask is met by several tasks, each with a part of the questions. Each
task grows its own tree and prunes in the same manner. No pair within the
distance is lost, whatever the sample.

The sample has `SAMPLE_EACH` points for each shard, so a 4096th of all points is
gathered, eight bytes each, and the tree has two nodes for each shard.

A text without words has fingerprint zero and is linked like any other. NULL
counts as such a text. Rows are documents: repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import shuffle_partitions, sorted_groups, stored, whole_row
from lendlane.llm.components import components

# Fixed value: the hash seed.
SEED = 42
SHINGLE = 3
MOST_BITS = 2
# Points a shard is meant to hold; points of the sample for each shard, and its least size.
SHARD_POINTS = 1 << 16
SAMPLE_EACH = 16
LEAST_SAMPLE = 1 << 14
# Questions that a task is meant to answer for a shard.
BLOCK_QUESTIONS = 1 << 17
LEAF_POINTS = 48
# Pairs held at once while a shard links its points.
PAIRS_AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = [0, *ends.tolist()], (ends[shingle - 1 :] - 1).tolist()
    return _majority(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of `docs`, which has `text`, and `fingerprint`, a long with the same 64 bits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text_bytes")]
            out = [batch.column(c) for c in columns] + [pa.array(np.array(found, dtype="<u8").view("<i8"))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "fingerprint"])

    rows = docs.select(*columns, F.col("text").cast("string").cast("binary").alias("text_bytes"))
    schema = rows.select(*columns).schema.add("fingerprint", "long")
    return rows.mapInArrow(hashed, schema)


def distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int64)


def grow(sample: np.ndarray, shards: int) -> list[tuple]:
    """A tree with about as many leaves as asked for: nodes (vantage point, radius, inside, outside) or (shard,)."""
    nodes: list[tuple] = []

    def node(points: np.ndarray, wanted: int) -> int:
        here = len(nodes)
        nodes.append(())
        if wanted > 1 and len(points) > 1:
            # Any point will do; of a few, the one whose median splits most evenly.
            tries = points[np.linspace(0, len(points) - 1, min(8, len(points))).astype(int)]
            splits = []
            for p in tries:
                d = distance(points, p)
                radius = int(np.median(d))
                inside = d <= radius
                if inside.all():  # ties at the largest distance
                    radius = int(d.min())
                    inside = d <= radius
                splits.append((abs(2 * int(inside.sum()) - len(points)), int(p), radius))
            _, p, radius = min(splits)
            inside = distance(points, np.uint64(p)) <= radius
            if not inside.all():
                part = max(1, round(wanted * inside.mean()))
                nodes[here] = (p, radius, node(points[inside], part), node(points[~inside], max(1, wanted - part)))
                return here
        nodes[here] = (here,)
        return here

    node(np.unique(sample), shards)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard the indices of the points that are kept or ask there, and whether it is their own.

    Where two points part, only the outer one asks for the inner one.
    """
    open_ = [(0, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while open_:
        at, index, own = open_.pop()
        if not len(index):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], index, own
            continue
        vantage, radius, inside, outside = nodes[at]
        d = distance(points[index], np.uint64(vantage))
        # Inside points are at most `radius` away, outside ones at least `radius + 1`.
        into, out = d <= radius + bits, np.where(own, d > radius, d >= radius + 1 - bits)
        open_.append((inside, index[into], own[into] & (d[into] <= radius)))
        open_.append((outside, index[out], own[out]))


def near_pairs(points: np.ndarray, asking: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different fingerprints (of `asking`, of `points`) within `bits`, each at least once."""
    open_ = [(points, asking)]
    while open_:
        here, ask = open_.pop()
        if not len(here) or not len(ask):
            continue
        if len(here) > LEAF_POINTS:
            vantage = here[len(here) // 2]
            d = distance(here, vantage)
            radius = int(np.median(d))
            inside = d <= radius
            if inside.all():
                radius = int(d.min())
                inside = d <= radius
            if not inside.all():
                asked = distance(ask, vantage)
                open_.append((here[inside], ask[asked <= radius + bits]))
                open_.append((here[~inside], ask[asked >= radius + 1 - bits]))
                continue
        step = max(1, PAIRS_AT_ONCE // len(here))
        for start in range(0, len(ask), step):
            some = ask[start : start + step]
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ here[None, :]) <= bits)
            apart = some[i] != here[j]
            if apart.any():
                yield some[i[apart]], here[j[apart]]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one edge a node: each node and the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def links(points: DataFrame, bits: int = MOST_BITS, shard_points: int = SHARD_POINTS, block_questions: int = BLOCK_QUESTIONS) -> DataFrame:
    """Edges (`a`, `b`) that connect all `points` (`fingerprint`, distinct longs) within `bits` of each other."""
    spark = points.sparkSession
    n = points.count()
    shards = max(1, -(-n // shard_points))
    # It decides how evenly the shards are filled, not what is found.
    sample = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(max(LEAST_SAMPLE, SAMPLE_EACH * shards)).select("fingerprint")
    chosen = sample.toArrow().column("fingerprint").combine_chunks().to_numpy(zero_copy_only=False).view("<u8")
    nodes = grow(chosen, shards)
    # How often a shard is asked, going by the sample; crowded ones are met by several tasks.
    blocks = {shard: max(1, -(-len(index) * n // (max(1, len(chosen)) * block_questions))) for shard, index, _ in route(nodes, chosen, bits)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            for shard, index, own in route(nodes, found.view("<u8"), bits):
                n_blocks, here = blocks.get(shard, 1), found[index]
                turn = (here.view("<u8") * _MIX >> np.uint64(32)).astype(np.int64) % n_blocks
                # Kept points are in all blocks of their shard, and ask in one.
                kept = here[own]
                rows = [(turn[~own], here[~own], False, True)] + [(np.full(len(kept), b), kept, True, turn[own] == b) for b in range(n_blocks)]
                for block, some, holds, asks in rows:
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), shard), pa.int32()), pa.array(block, pa.int32()), pa.array(some),
                             pa.array(np.broadcast_to(holds, len(some))), pa.array(np.broadcast_to(asks, len(some)))],
                            names=["shard", "block", "fingerprint", "holds", "asks"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["shard", "block"]):
            all_points = table.column("fingerprint").to_numpy().view("<u8")
            holds, asks = (table.column(c).to_numpy() for c in ("holds", "asks"))
            a = b = np.empty(0, dtype="<u8")
            for x, y in near_pairs(all_points[holds], all_points[asks], bits):
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) > PAIRS_AT_ONCE:
                    a, b = stars(a, b)
            a, b = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    kept = points.mapInArrow(dealt, "shard int, block int, fingerprint long, holds boolean, asks boolean")
    by_task = kept.repartition(shuffle_partitions(spark), "shard", "block").sortWithinPartitions("shard", "block")
    return by_task.mapInArrow(linked, "a long, b long")


def group_fingerprints(hashed: DataFrame, bits: int = MOST_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per fingerprint of stored `hashed` (`doc_id`, `fingerprint`).

    `root` names its group, `component_id` is the smallest doc_id in the group
    (NULL if all are NULL), `kept_fingerprint` the smallest fingerprint with that doc_id.
    """
    # Copies meet here, already reduced to one row per task and fingerprint.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "fingerprint"))
    points = stored(hashed.groupBy("fingerprint").agg(least.alias("least")), "fingerprints")
    rooted = components(links(points.select("fingerprint"), bits, shard_points))
    placed = points.join(rooted, points["fingerprint"] == rooted["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("first"))
    return placed.join(firsts, "root").select(
        "fingerprint", "root", F.col("first.doc_id").alias("component_id"), F.col("first.fingerprint").alias("kept_fingerprint"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MOST_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits) and `component_id` for each row of `docs` (`doc_id`, `text`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = stored(fingerprints(rows, shingle), "simhash")
    groups = group_fingerprints(hashed, bits, shard_points).select("fingerprint", "component_id")
    found = hashed.join(groups, "fingerprint")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = MOST_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """`docs` (all its columns) with one row of each group: that with the smallest doc_id, NULL after all others."""
    columns = tuple(docs.columns)
    whole = whole_row(list(columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", whole)
    hashed = stored(fingerprints(rows, shingle, ("doc_id", "row")), "simhash-rows")
    groups = group_fingerprints(hashed.select("doc_id", "fingerprint"), bits, shard_points)
    kept = groups.select(F.col("component_id").alias("k_doc"), F.col("kept_fingerprint").alias("k_mark")).distinct()
    same = hashed["doc_id"].eqNullSafe(kept["k_doc"]) & (hashed["fingerprint"] == kept["k_mark"])
    # The two keys are those of the join, so repeated rows go without another shuffle.
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "fingerprint"]).select("row.*")
