"""Token-ID output: files of frequency-ranked ids in byte-aligned variable-length code.

A folder of Parquet files, one row per block, so that Spark's committer and any
store that Spark can write to hold them. A block holds whole documents and
decodes on its own. Its bytes:

    header    magic, number of documents, of ids, of distinct ids, of data bytes, crc32 of the rest
    doc ids   a signed 64-bit integer each, then a byte each that is 1 if the doc id is NULL
    lengths   an unsigned 64-bit number of ids each
    ranks     the distinct ids of the block, most frequent first, unsigned 32-bit each
    control   two bits for each id, four ids to a byte: the bytes of its rank, less one
    data      the ranks, little-endian, without leading zero bytes

Ranks are taken over all ids of the block: the commonest 256 ids cost a byte and
two bits. Because a block carries its own ranks, one pass over the corpus is
enough, and a lost task is written again without the others.

Documents are in ascending `doc_id` order (NULL first, equal ids by the beginning of their texts, then as they were stored); a
document without text holds the end id only. Empty input gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.llm.common import kept_by_worker, shuffle_partitions
from lendlane.llm.word_bpe import TEXTS_AT_ONCE, WordBpe, with_end

MAGIC = b"FRB1"
HEADER = "<4sQQQQI"
# A block is closed by the document that brings it to this many ids.
BLOCK_IDS = 1 << 20
# Characters of a text by which rows of one id are dealt.
HEAD = 32
BLOCKS = "part int, seq int, first_in_part long, n_docs long, n_ids long, block binary"

# For each control byte: which of 4 x 4 bytes its four ranks fill.
_WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
FILLED = (np.arange(4) <= _WIDTHS[:, :, None]).reshape(256, 16)


def encode_block(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block of documents: all their ids, one after the other, and how many each has."""
    ids = ids.astype("<u4", copy=False)
    found, counts = np.unique(ids, return_counts=True) if len(ids) < 4096 else _counted(ids)
    order = np.argsort(-counts, kind="stable")
    ranked = found[order]
    rank_of = np.empty(int(found[-1]) + 1 if len(found) else 0, dtype="<u4")
    rank_of[ranked] = np.arange(len(ranked), dtype="<u4")
    ranks = rank_of[ids]
    width = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    padded[: len(ids)] = width
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    filled = np.arange(4) <= width[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[filled].tobytes()
    body = b"".join([
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        lengths.astype("<u8").tobytes(),
        ranked.astype("<u4").tobytes(), control.tobytes(), data,
    ])
    return struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(ranked), len(data), zlib.crc32(body)) + body


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with counts, without sorting; ids are small numbers."""
    counts = np.bincount(ids)
    found = np.flatnonzero(counts)
    return found.astype("<u4"), counts[found]


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, lengths, and all ids one after the other."""
    magic, n_docs, n_ids, n_ranks, n_data, crc = struct.unpack_from(HEADER, block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[struct.calcsize(HEADER) :]) != crc:
        raise ValueError("not a whole block of ranked token ids")
    at = struct.calcsize(HEADER)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(block, dtype=kind, count=n, offset=at)
        at += part.nbytes
        return part

    doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    ranked, control, data = take("<u4", n_ranks), take("u1", -(-n_ids // 4)), take("u1", n_data)
    filled = FILLED[control].reshape(-1)
    filled[n_ids * 4 :] = False  # the last control byte may stand for fewer than four
    ranks = np.zeros(len(filled), dtype=np.uint8)
    ranks[filled] = data
    ids = ranked[ranks.view("<u4")[:n_ids]] if n_ids else np.empty(0, dtype="<u4")
    return [None if z else d for d, z in zip(doc_ids.tolist(), nulls)], lengths.astype(np.int64), ids


def write(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2,
          block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts of `docs` (`doc_id`, `text`) and write them in `doc_id` order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(f"bpe {vocabulary}", lambda: WordBpe(vocabulary))
        part = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        before, seq = 0, 0
        # Documents of the block that is still open.
        doc_ids: list[int | None] = []
        ids, lengths = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)

        def closed(n_docs: int) -> pa.RecordBatch:
            """The first of the documents as a block; the others stay."""
            nonlocal doc_ids, ids, lengths, before, seq
            n_ids = int(lengths[:n_docs].sum())
            row = [part, seq, before, n_docs, n_ids, encode_block(doc_ids[:n_docs], ids[:n_ids], lengths[:n_docs])]
            doc_ids, ids, lengths, before, seq = doc_ids[n_docs:], ids[n_ids:], lengths[n_docs:], before + n_ids, seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "seq", "first_in_part", "n_docs", "n_ids", "block"])

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(start, TEXTS_AT_ONCE)
                more, counts = with_end(*bpe.encode_arrays(some.column("text")), end_id)
                doc_ids += some.column("doc_id").to_pylist()
                ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, counts])
                while len(ids) >= block_ids:
                    yield closed(int(np.searchsorted(np.cumsum(lengths), block_ids)) + 1)
        if doc_ids:
            yield closed(len(doc_ids))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The number is given, so that partitions stay as dealt: their order is the order of the ids. Rows of one id, or without
    # one, are dealt by text, and equal rows one by one.
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "head", "row"]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(blocks, BLOCKS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in a written folder: `doc_id`, `start` (ids of all before it), `ids` (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    # One row for each partition that was written, whatever the size of the corpus.
    sizes = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, block in zip(*(batch.column(c).to_pylist() for c in ("part", "first_in_part", "block"))):
                doc_ids, lengths, ids = decode_block(block)
                ends = np.cumsum(lengths)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + starts[part] + first, pa.int64()), raw,
                ], names=["doc_id", "start", "ids"])

    return blocks.select("part", "first_in_part", "block").mapInArrow(documents, "doc_id long, start long, ids binary")
