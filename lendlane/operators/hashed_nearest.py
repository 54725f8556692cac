"""Most of the k nearest neighbours, by locality-sensitive hashing: for corpora too large for an exact search.

A table of buckets hashes a vector by the signs of its products with `bits` fixed
directions of +1 and -1. Queries and corpus rows travel to the task of their bucket in packs, where a matrix
product finds the closest and only these are measured; a bucket of many rows is cut into slices by the hash of
the id, which all queries of the bucket visit. So a row travels once a table, and a query keeps k rows of each slice.
Distances are exact. More tables find more, more bits meet less. The defaults are set by
neighbours at a cosine of about a third, which share the sign of a product with six
directions in ten only: at least nine in ten of the three nearest are found, and about
three pairs in five are met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lendlane.operators.nearest import MOST_TASKS, _floating, _raw_type, _Task, _vectors, met, packing

TABLES = 56
BITS = 6
# Corpus rows of a slice of a bucket, and queries of a pack, at most.
SLICE_ROWS = 1 << 15
PACK_ROWS = 1 << 10
# Rows of buckets that a task sees, about, and the fewest tasks.
TASK_ROWS = 1 << 16
LEAST_TASKS = 32
_SEED = 20


def directions(dimensions: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """Rows of +1 and -1, shaped (tables, bits, dimensions); the same in every run."""
    return np.random.default_rng(_SEED).integers(0, 2, (tables, bits, dimensions)) * 2 - 1


def _codes(values: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The number of each vector's bucket among those of all tables, a column a table."""
    tables, bits, dimensions = signs.shape
    flat, powers = signs.reshape(-1, dimensions).T.astype(np.float64), 1 << np.arange(bits)
    codes = ((values @ flat >= 0).reshape(-1, tables, bits) * powers).sum(2)
    return codes + (np.arange(tables) << bits)


def nearest_hashed(queries: DataFrame, corpus: DataFrame, dimensions: int, k: int = 3, query_id: str = "query_id",
                   corpus_id: str = "chunk_id", vector: str = "embedding", skip_same: bool = False,
                   tables: int = TABLES, bits: int = BITS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k nearest corpus rows among those that share a bucket with the query: query id, `rank`, corpus id, `distance`.

    Vectors that are NULL or of another width find nothing. Ranked by distance to nine
    places, then by id. A table of buckets keeps k rows per query before the tables meet.
    """
    signs = directions(dimensions, tables, bits)
    whole = F.size(vector) == dimensions
    # A NULL id is not known to be another one.
    known = lambda key: F.col(key).isNotNull() if skip_same else F.lit(True)
    q = queries.where(whole & known(query_id)).select(F.col(query_id), _floating(queries, vector))
    c = corpus.where(whole & known(corpus_id)).select(F.col(corpus_id), _floating(corpus, vector))

    def counted(batches):
        for b in batches:
            buckets, n = np.unique(_codes(_vectors(b.column(vector)), signs), return_counts=True) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], names=["bucket", "n"])

    # One number per bucket comes back. A bucket's slices follow those of the bucket before.
    held = np.zeros(tables << bits, dtype=np.int64)
    for bucket, n in c.select(vector).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        held[bucket] = n
    parts = -(-held // slice_rows)
    first = np.cumsum(parts) - parts
    table_of = np.repeat(np.arange(tables << bits) >> bits, parts)
    shape, corpus_pack, query_pack = packing(q, c, query_id, corpus_id, vector)

    def of_slices(at, rows):
        """Rows by slice: the slice and the numbers of its rows."""
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order])) + 1
        for some in np.split(order, cut) if len(order) else []:
            yield int(at[some[0]]), rows[some]

    def to_slices(batches):
        for b in batches:
            if b.num_rows:
                values = _vectors(b.column(vector))
                codes, hashed = _codes(values, signs), b.column("id_hash").to_numpy()
                at = first[codes] + hashed[:, None] % np.maximum(parts[codes], 1)
                for one, rows in of_slices(at.ravel(), np.repeat(np.arange(len(values)), tables)):
                    yield corpus_pack([one], np.zeros(len(rows)), b.column(corpus_id).take(pa.array(rows)), values[rows])

    def to_packs(batches):
        for b in batches:
            if b.num_rows:
                values = _vectors(b.column(vector))
                for bucket, rows in of_slices(_codes(values, signs).ravel(), np.repeat(np.arange(len(values)), tables)):
                    slices = list(range(int(first[bucket]), int(first[bucket] + parts[bucket])))
                    for i in range(0, len(rows) if slices else 0, PACK_ROWS):
                        some = rows[i:i + PACK_ROWS]
                        yield query_pack(slices, [], b.column(query_id).take(pa.array(some)), values[some])

    found = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField(query_id, q.schema[query_id].dataType),
                          T.StructField("rank", T.IntegerType()), T.StructField(corpus_id, c.schema[corpus_id].dataType),
                          T.StructField("distance", T.DoubleType())])
    if not parts.sum():
        return q.sparkSession.createDataFrame([], T.StructType(found.fields[1:]))
    rows = c.withColumn("id_hash", F.xxhash64(corpus_id)).mapInArrow(to_slices, shape).unionByName(q.mapInArrow(to_packs, shape))
    slotted = rows.select(F.explode("slices").alias("slot"), *shape.names[1:])
    task = _Task(k, skip_same, found.names[1:], whole_ids=True)
    met_rows = met(slotted, int(parts.sum()), found, task, _raw_type(q, vector), _raw_type(c, vector), 0, tables_of=table_of,
                   tasks=min(max(LEAST_TASKS, -(-int(held.sum()) // TASK_ROWS)), MOST_TASKS))
    # Rows of a query come together once; the three steps below need no other shuffle.
    measured = met_rows.withColumnRenamed("slot", "table").drop("rank").repartition(query_id)
    order = [F.round("distance", 9), F.col(corpus_id)]
    per_table = Window.partitionBy(query_id, "table").orderBy(*order)
    close = measured.withColumn("rank", F.row_number().over(per_table)).where(F.col("rank") <= k)
    once = close.groupBy(query_id, corpus_id).agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(query_id, "rank", corpus_id, "distance")
