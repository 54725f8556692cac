"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last `WINDOW` bytes rolls over the UTF-8 text. Where its lowest bits are zero a piece ends; how many bits is
a matter of the block size, a power of two. Each piece is hashed to one symbol of two characters, so an
edit changes the symbols near it and no others. The block size is the smallest that gives at most `MOST_PIECES`
pieces, whatever the length of the text: all of it is hashed. A fingerprint is `block size:pieces:pieces at twice
the block size`.

Fingerprints whose block sizes are equal, or one twice the other, are compared by the edit distance of their
pieces at a size they share: the likeness is 1 less distance over the longer length, the best of the shared sizes.
Others have likeness 0. Equal texts have equal fingerprints, and equal fingerprints likeness 1.

NULL is an empty text, which has no pieces; it is like another empty text only. Long texts are hashed slice by
slice, with only the piece ends that may still count remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lendlane.llm.common import shuffle_partitions, stored

WINDOW = 7
MOST_PIECES = 64
LEAST_BITS = 2
LEVELS = 32
# Bytes hashed at once.
SLICE = 1 << 20
TEXTS_AT_ONCE = 2000
PAIRS_AT_ONCE = 1000
# Fixed value: the characters of a symbol.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
VALUE = np.zeros(256, dtype=np.uint16)
VALUE[ALPHABET] = np.arange(64)

ROLL = 0x9E3779B1
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_PAD = bytes(WINDOW - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the piece hash's base and of its inverse, grown as needed."""

    up = down = np.empty(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(UNBASE, n)
        return cls.up, cls.down


def _rolled(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each byte and the `WINDOW` - 1 before it."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    for k in range(1, WINDOW):
        out[k:] += wide[:-k] * np.uint32(pow(ROLL, k, 1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(12))


def _ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that may end a piece, the bits beyond the least that allow it, and the sums of the piece hash before each byte."""
    rolled = _rolled(data)
    hit = np.flatnonzero((rolled & np.uint32((1 << LEAST_BITS) - 1)) == 0)
    lowest = rolled[hit] & -rolled[hit]
    level = np.where(lowest == 0, LEVELS - 2, np.log2(np.maximum(lowest, 1)).astype(np.int64) - LEAST_BITS)
    up, _ = _Tables.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return hit, level, sums


def _many(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts short enough to be hashed side by side."""
    data = np.frombuffer(b"".join([_PAD + t for t in texts]), dtype=np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(length + len(_PAD))
    start = stop - length
    hit, level, sums = _ends(data)
    _, down = _Tables.upto(len(data) + 1)
    owner = np.searchsorted(stop, hit, side="right")
    inside = hit >= start[owner]
    hit, level, owner = hit[inside], level[inside], owner[inside]
    own = lambda at, text: (sums[at] - sums[start[text]]) * down[start[text]]
    return _written(owner, hit + 1 - start[owner], level, own(hit + 1, owner), length, own(stop, np.arange(len(texts))))


def _long(text: bytes) -> str:
    """The fingerprint of one text, slice by slice."""
    at, levels, sums = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    total, least, lead = 0, 0, _PAD
    for begin in range(0, len(text), SLICE):
        part = text[begin : begin + SLICE]
        hit, level, here = _ends(np.frombuffer(lead + part, dtype=np.uint8))
        inside = hit >= len(lead)
        # Sums of the slice, moved to its place in the text.
        factor = np.uint64(pow(BASE, begin, 1 << 64) * pow(UNBASE, len(lead), 1 << 64) % (1 << 64))
        here = (here - here[len(lead)]) * factor + np.uint64(total)
        at = np.concatenate([at, hit[inside] + 1 - len(lead) + begin])
        levels, sums = np.concatenate([levels, level[inside]]), np.concatenate([sums, here[hit[inside] + 1]])
        total, lead = int(here[-1]), part[-len(_PAD):]
        # Levels with too many ends are never chosen.
        few = np.bincount(levels, minlength=LEVELS)[::-1].cumsum()[::-1] < MOST_PIECES
        least = max(least, int(few.argmax()))
        keep = levels >= least
        at, levels, sums = at[keep], levels[keep], sums[keep]
    one = np.zeros(len(at), dtype=np.int64)
    return _written(one, at, levels, sums, np.array([len(text)]), np.array([total], dtype=np.uint64), least)[0]


def _written(owner: np.ndarray, at: np.ndarray, level: np.ndarray, sums: np.ndarray, length: np.ndarray, total: np.ndarray,
             floor: int = 0) -> list[str]:
    """Fingerprints from piece ends (text, bytes before it, level, sum there), lengths and whole sums; no level under `floor`."""
    n = len(length)
    counts = np.bincount(owner * LEVELS + level, minlength=n * LEVELS).reshape(n, LEVELS)
    chosen = np.maximum((counts[:, ::-1].cumsum(axis=1)[:, ::-1] < MOST_PIECES).argmax(axis=1), floor)
    some = np.flatnonzero(length)

    def pieces(least: np.ndarray) -> list[str]:
        keep = (level >= least[owner]) & (at < length[owner])
        text, end = np.concatenate([owner[keep], some]), np.concatenate([at[keep], length[some]])
        upto = np.concatenate([sums[keep], total[some]])
        order = np.lexsort((end, text))
        text, end, upto = text[order], end[order], upto[order]
        same = np.diff(text, prepend=-1) == 0
        before = np.where(same, np.roll(end, 1), 0)
        _, down = _Tables.upto(1)
        far = before.max(initial=0) >= len(down)
        back = np.array([pow(UNBASE, b, 1 << 64) for b in before.tolist()], dtype=np.uint64) if far else down[before]
        hashed = (upto - np.where(same, np.roll(upto, 1), np.uint64(0))) * back
        hashed ^= hashed >> np.uint64(32)
        symbol = ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64)
        chars = ALPHABET[np.stack([symbol >> 6, symbol & 63], axis=1)].tobytes().decode("ascii")
        stops = np.searchsorted(text, np.arange(n), side="right").tolist()
        return [chars[2 * a : 2 * b] for a, b in zip([0, *stops], stops)]

    one, two = pieces(chosen), pieces(chosen + 1)
    return [f"{1 << (LEAST_BITS + k)}:{a}:{b}" for k, a, b in zip(chosen.tolist(), one, two)]


def fingerprint_all(texts: list[bytes | None]) -> list[str]:
    """A fingerprint for each UTF-8 text."""
    out: list[str] = [""] * len(texts)
    group: list[int] = []
    size = 0

    def close() -> None:
        for i, found in zip(group, _many([texts[i] or b"" for i in group]) if group else []):
            out[i] = found

    for i, text in enumerate(texts):
        n = len(text or b"")
        if n > SLICE:
            out[i] = _long(text)
            continue
        group.append(i)
        size += n
        if size > SLICE or len(group) >= TEXTS_AT_ONCE:
            close()
            group, size = [], 0
    close()
    return out


def edit_distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each pair of symbol sequences of at most 64; all pairs side by side, a bit for each symbol of `a`."""
    n = len(a)
    m, k = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    left, right = np.zeros((n, 64), dtype=np.int32), np.full((n, max(1, int(k.max(initial=0)))), -1, dtype=np.int32)
    left -= 2
    for row, x, y in zip(range(n), a, b):
        left[row, : len(x)], right[row, : len(y)] = x, y
    one, top = np.uint64(1), np.uint64(1) << np.maximum(m - 1, 0).astype(np.uint64)
    equal = np.packbits(left[:, None, :] == right[:, :, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    score = m.copy()
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    for j in range(int(k.max(initial=0))):
        here = equal[:, j]
        down = here | minus
        across = (((here & plus) + plus) ^ plus) | here
        more, less = minus | ~(across | plus), plus & across
        score += np.where(j < k, ((more & top) != 0).astype(np.int64) - ((less & top) != 0), 0)
        more, less = (more << one) | one, less << one
        plus, minus = less | ~(down | more), more & down
    return np.where(m == 0, k, score)


def _parsed(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    block, one, two = fingerprint.split(":")
    symbols = lambda s: VALUE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)].reshape(-1, 2) @ np.array([64, 1], dtype=np.uint16)
    return int(block), symbols(one), symbols(two)


def likenesses(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of fingerprints."""
    out = np.zeros(len(pairs))
    known: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
    for begin in range(0, len(pairs), PAIRS_AT_ONCE):
        at, left, right = [], [], []
        known.clear()
        for i, (a, b) in enumerate(pairs[begin : begin + PAIRS_AT_ONCE], begin):
            if a == b:
                out[i] = 1.0
                continue
            (n, a1, a2), (m, b1, b2) = (known.get(x) or known.setdefault(x, _parsed(x)) for x in (a, b))
            shared = [(a1, b1), (a2, b2)] if n == m else [(a2, b1)] if 2 * n == m else [(a1, b2)] if n == 2 * m else []
            for x, y in shared:
                at.append(i)
                left.append(x)
                right.append(y)
        if at:
            longer = np.maximum([len(x) for x in left], [len(y) for y in right])
            np.maximum.at(out, at, 1 - edit_distances(left, right) / np.maximum(longer, 1))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id` and `fingerprint` of each row of `docs` (`doc_id`, `text`)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprint_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fingerprint string")


def compare(pairs: DataFrame, a: str, b: str, likeness: str) -> DataFrame:
    """`pairs` with the likeness of two fingerprint columns; NULL if one is NULL."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()))
            there = [i for i, (x, y) in enumerate(both) if x is not None and y is not None]
            out = np.full(len(both), np.nan)
            out[there] = likenesses([both[i] for i in there])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=np.isnan(out))], names=[*batch.schema.names, likeness])

    return pairs.mapInArrow(compared, StructType([*pairs.schema.fields, StructField(likeness, DoubleType())]))


def half_replaced(text: str, by: str) -> str:
    """`text` with its last half, rounded down, replaced by as many of the first characters of `by`."""
    half = len(text) // 2
    return text[: len(text) - half] + by[:half]


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(doc_ids: list, texts: list[str], marks: list[str], next_texts: list[str], next_marks: list[str]) -> list[pa.Array]:
    """The columns of `COMPARED`."""
    edited = [half_replaced(t, n).encode() for t, n in zip(texts, next_texts)]
    edited_marks = fingerprint_all(edited)
    near = likenesses([*zip(marks, edited_marks), *zip(marks, next_marks)])
    columns = [doc_ids, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], marks, edited_marks,
               near[: len(texts)], near[len(texts) :]]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS)]


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Each row of `docs` (`doc_id`, `text`) against its text with the last half replaced from the next one, and against that.

    Next is by descending `doc_id`, NULL last, equal ids by a hash of the text; after the last comes the first.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order through a partition: every row but the last knows its next one here. The first and last are handed on."""
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        empty = lambda n, kind: pa.nulls(n, kind)

        def edge(first: bool, row: tuple) -> pa.RecordBatch:
            doc_id, text, mark = row
            known = {"doc_id": doc_id, "fingerprint": mark}
            columns = [pa.array([known.get(c)], k) for c, k in zip(_NAMES, _KINDS)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([part], pa.int32()), pa.array([first]), pa.array([text], pa.string())], names=names)

        names = [*_NAMES, "part", "is_first", "edge_text"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                ids, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
                rows = list(zip(ids, texts, fingerprint_all([t.encode() for t in texts])))
                if last is None:
                    yield edge(True, rows[0])
                else:
                    rows.insert(0, last)
                last = rows[-1]
                if len(rows) > 1:
                    (ids, texts, marks), (_, nexts, next_marks) = zip(*rows[:-1]), zip(*rows[1:])
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [*_compared(ids, texts, marks, nexts, next_marks), pa.array([part] * n, pa.int32()), empty(n, pa.bool_()),
                         empty(n, pa.string())], names=names)
        if last is not None:
            yield edge(False, last)

    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Equal rows are told apart too, so that no id and no text has to fit one partition.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("draw"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("draw"), F.col("row")]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = stored(dealt.mapInArrow(walked, f"{COMPARED}, part int, is_first boolean, edge_text string"), "piecewise")
    # One number for each partition with rows.
    parts = sorted(r.part for r in done.where("is_first").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    lasts = done.where("not is_first").select("doc_id", "fingerprint", F.col("edge_text").alias("text"), "part")
    firsts = done.where("is_first").select(
        F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    edges = lasts.join(after, "part").join(firsts, "next_part")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pydict()
                yield pa.RecordBatch.from_arrays(
                    _compared(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_mark"]), names=_NAMES)

    return done.where("is_first is null").select(*_NAMES).unionByName(edges.mapInArrow(finished, COMPARED))
