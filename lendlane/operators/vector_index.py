"""A stored vector index: cells around trained centres, residual product codes, and an exact look at the best.

`build` writes three tables into a folder:

* `model`: one row with the centres, the codebooks and the two settings of the search;
* `codes`, partitioned by cell: a row holds up to `BLOCK_ROWS` ids and their codes, a byte for each part
  of the vector less its centre;
* `rows`, partitioned by cell: id, vector and carried columns.

Centres come from k-means|| and codebooks from k-means over a sample of at most `SAMPLE_ROWS` rows, drawn by a hash
of the id; every row of the corpus is indexed. A question reads the codes of its nearest cells only (the
others' partitions are pruned), keeps the rows whose codes are nearest, and measures those exactly. How many
cells (`probes`) and rows (`shortlist`) that takes is found out when the index is
built: sample rows are asked for their neighbours in the sample, and both settings are the least that find `target`
of them. Where vectors cluster, that is a few cells; where they do not, many. `recall` measures what a search found.

`append` adds rows under the same centres and codebooks. Vectors that are NULL, hold NULL or are of another width are not
indexed, and ask for nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lendlane.session import shared_folder

SAMPLE_ROWS = 1 << 14
# Cells by default: twice the square root of the corpus, between these.
CELLS = (8, 4096)
PARTS = 16
ENTRIES = 256
TARGET = 0.95
# Sample rows asked when the settings are found, and the neighbours asked for.
ASKED = 256
BLOCK_ROWS = 1024
# Blocks that one task of a search visits, at most, for one pack of questions.
SHARD_BLOCKS = 64
PACK_ROWS = 256
_SEED = 20
_PLACES = 9

MODEL = ("cells int, width int, centres binary, codebooks binary, parts int, probes int, shortlist int, sample_rows long, "
         "indexed_rows long, row_schema string")


@dataclass(frozen=True)
class Model:
    """Centres (cell x width) and codebooks (part x entry x width of a part), as single precision."""

    centres: np.ndarray
    codebooks: np.ndarray
    probes: int
    shortlist: int
    sample_rows: int
    indexed_rows: int
    # Of the table `rows`, as JSON; a table without rows has no files to tell it.
    row_schema: str = ""

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        return _squares(vectors, self.centres)

    def codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """A byte for each part: the entry nearest to that part of the residual."""
        left = _padded(vectors - self.centres[cells], self.codebooks.shape)
        return np.stack([_nearest(left[:, p], book) for p, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def coded_squares(self, questions: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of questions to what the codes of one cell stand for, by table look-up."""
        left = _padded(questions - self.centres[cell], self.codebooks.shape)
        out = np.zeros((len(questions), len(codes)), dtype=np.float32)
        for p, book in enumerate(self.codebooks):
            out += _squares(left[:, p], book)[:, codes[:, p]]
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _nearest(points: np.ndarray, centres: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    found = [_squares(points[i : i + at_once], centres).argmin(1) for i in range(0, len(points), at_once)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _padded(vectors: np.ndarray, shape: tuple) -> np.ndarray:
    """Vectors cut into parts, the last filled up with zeros."""
    parts, _, width = shape
    out = np.zeros((len(vectors), parts * width), dtype=np.float32)
    out[:, : vectors.shape[1]] = vectors
    return out.reshape(len(vectors), parts, width)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _usable(df: DataFrame, vector: str, width: int) -> DataFrame:
    whole = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    as_float = F.transform(vector, lambda x: x.cast("float"))
    return df.where(F.coalesce(whole, F.lit(False))).withColumn(vector, as_float)


def _codebooks(residuals: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """k-means for each part of the sampled residuals (`r`, an array), a task for each part."""
    part_width = -(-width // parts)

    def fit(key, rows):
        import pandas as pd

        points = np.stack(rows["x"].to_numpy()).astype(np.float32)
        random = np.random.default_rng([_SEED, int(key[0])])
        book = points[random.permutation(len(points))[:entries]]
        for _ in range(12):
            own = _nearest(points, book)
            n = np.bincount(own, minlength=len(book))
            sums = np.stack([np.bincount(own, points[:, j], len(book)) for j in range(points.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
        return pd.DataFrame({"part": [int(key[0])], "book": [book.reshape(-1).tolist()]})

    filled = F.concat("r", F.array_repeat(F.lit(0.0).cast("float"), parts * part_width - width))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(filled, p * part_width + 1, part_width))
    fitted = residuals.select("at", F.posexplode(cut).alias("part", "x")).groupBy("part").applyInPandas(fit, "part int, book array<float>")
    books = {r.part: np.array(r.book, dtype=np.float32).reshape(-1, part_width) for r in fitted.collect()}
    return np.stack([books[p] for p in range(parts)])


def _settings(model: Model, sample: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """The fewest cells and the shortest list that find `target` of the neighbours of sample rows among the sample."""
    asked = sample[np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)]
    own = _nearest(sample, model.centres)
    order = model.cells_of(asked).argsort(axis=1)
    rank_of_cell = order.argsort(axis=1)
    exact = _squares(asked, sample)
    exact[np.arange(len(asked)), exact.argmin(axis=1)] = np.inf  # the row itself, or its copy
    k = min(k, max(1, len(sample) - 1))
    true = np.argpartition(exact, k - 1, axis=1)[:, :k]
    each = math.sqrt(target)
    rank = rank_of_cell[np.arange(len(asked))[:, None], own[true]]
    probes = int(np.quantile(rank, each, method="higher")) + 1
    coded = np.full(exact.shape, np.inf, dtype=np.float32)
    codes = model.codes(sample, own)
    for cell in range(len(model.centres)):
        rows = np.flatnonzero(own == cell)
        who = np.flatnonzero(rank_of_cell[:, cell] < probes)
        if len(rows) and len(who):
            coded[np.ix_(who, rows)] = model.coded_squares(asked[who], cell, codes[rows])
    place = coded.argsort(axis=1).argsort(axis=1)[np.arange(len(asked))[:, None], true]
    found = place[np.isfinite(np.take_along_axis(coded, true, axis=1))]
    return probes, max(k, int(np.quantile(found, each, method="higher")) + 2) if len(found) else k


def train(corpus: DataFrame, key: str = "chunk_id", vector: str = "embedding", cells: int | None = None, parts: int = PARTS,
          k: int = 3, target: float = TARGET, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Centres, codebooks and settings, from a sample of a stored corpus."""
    width = corpus.agg(F.max(F.size(vector))).first()[0] or 1
    rows = _usable(corpus.select(key, vector), vector, width)
    n = rows.count()
    if not n:
        return Model(np.zeros((1, width), np.float32), np.zeros((parts, 1, -(-width // parts)), np.float32), 1, k, 0, 0)
    # One partition of a bounded sample, in a fixed order: a rerun trains the same.
    sample = rows.orderBy(F.xxhash64(key), key).limit(sample_rows).select(F.col(vector).alias("r"))
    points = _matrix(sample.toArrow().column("r").combine_chunks(), width)
    cells = cells or min(max(2 * math.isqrt(n), CELLS[0]), CELLS[1], len(points))
    if cells > 1 and len(np.unique(points, axis=0)) > 1:
        means = KMeans(k=cells, seed=_SEED, initMode="k-means||", maxIter=15, featuresCol="f")
        centres = np.array(means.fit(sample.select(array_to_vector("r").alias("f"))).clusterCenters(), dtype=np.float32)
    else:
        centres = points[:1]
    left = points - centres[_nearest(points, centres)]
    spark = corpus.sparkSession
    residuals = spark.createDataFrame(pa.table({"at": np.arange(len(left)), "r": pa.FixedSizeListArray.from_arrays(
        left.reshape(-1), width).cast(pa.list_(pa.float32()))}))
    model = Model(centres, _codebooks(residuals, parts, width, min(ENTRIES, len(points))), 1, k, len(points), n)
    probes, shortlist = _settings(model, points, k, target)
    # A corpus larger than its sample has more rows that seem as near.
    grown = math.ceil(shortlist * math.sqrt(n / len(points)))
    return Model(centres, model.codebooks, probes, min(n, grown), len(points), n)


def _save(spark: SparkSession, model: Model, folder: str) -> None:
    row = (len(model.centres), model.width, model.centres.tobytes(), model.codebooks.tobytes(), len(model.codebooks),
           model.probes, model.shortlist, model.sample_rows, model.indexed_rows, model.row_schema)
    spark.createDataFrame([row], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")


def load(spark: SparkSession, folder: str) -> Model:
    r = spark.read.schema(MODEL).parquet(f"{folder}/model").first()
    centres = np.frombuffer(r.centres, dtype=np.float32).reshape(r.cells, r.width)
    books = np.frombuffer(r.codebooks, dtype=np.float32).reshape(r.parts, -1, -(-r.width // r.parts))
    return Model(centres, books, r.probes, r.shortlist, r.sample_rows, r.indexed_rows, r.row_schema)


def build(corpus: DataFrame, folder: str, key: str = "chunk_id", vector: str = "embedding", carry: tuple = (), **options) -> Model:
    """Train on a stored corpus and write its index to `folder`."""
    model = train(corpus, key, vector, **options)
    shape = _usable(corpus.select(key, vector, *carry), vector, model.width).withColumn("cell", F.lit(0)).schema
    model = replace(model, row_schema=T.StructType([T.StructField(f.name, f.dataType) for f in shape]).json())
    _save(corpus.sparkSession, model, folder)
    append(corpus, folder, key, vector, carry, model)
    return model


def append(rows: DataFrame, folder: str, key: str = "chunk_id", vector: str = "embedding", carry: tuple = (),
           model: Model | None = None) -> None:
    """Index more rows under the centres and codebooks of `folder`."""
    spark = rows.sparkSession
    model = model or load(spark, folder)
    given = _usable(rows.select(key, vector, *carry), vector, model.width)

    def assigned(batches):
        for b in batches:
            points = _matrix(b.column(vector), model.width)
            cells = _nearest(points, model.centres)
            codes = model.codes(points, cells)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=[*b.schema.names, "cell", "code"])

    celled = T.StructType([*given.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
    # Kept, so that rows are assigned once.
    place = shared_folder(spark, "index-rows")
    given.mapInArrow(assigned, celled).write.parquet(place)
    kept = spark.read.schema(celled).parquet(place)
    # One row for each cell: shards of cells that are crowded.
    sizes = {r.cell: r["count"] for r in kept.groupBy("cell").count().collect()}
    shards = [max(1, -(-sizes.get(c, 0) // (BLOCK_ROWS * SHARD_BLOCKS))) for c in range(len(model.centres))]
    n_shards = F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("cell") + 1)
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64(key), n_shards).cast("int"))
    dealt = dealt.repartition("cell", "shard").sortWithinPartitions("cell", "shard", key)

    def blocks(batches):
        held, where = [], None

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(key).chunk(0)
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int32()), pa.ListArray.from_arrays(whole, ids),
                 pa.array([b"".join(table.column("code").to_pylist())], pa.binary())], names=["cell", "shard", "ids", "codes"])

        for b in batches:
            places = list(zip(b.column("cell").to_pylist(), b.column("shard").to_pylist()))
            begin = 0
            while begin < len(places):
                if places[begin] != where or sum(x.num_rows for x in held) >= BLOCK_ROWS:
                    if held:
                        yield block()
                    held, where = [], places[begin]
                end, room = begin, BLOCK_ROWS - sum(x.num_rows for x in held)
                while end < len(places) and places[end] == where and end - begin < room:
                    end += 1
                held.append(b.slice(begin, end - begin))
                begin = end
        if held:
            yield block()

    packed = dealt.select(key, "code", "cell", "shard").mapInArrow(blocks, _blocks_of(given.schema[key].dataType))
    packed.write.mode("append").partitionBy("cell").parquet(f"{folder}/codes")
    dealt.select("cell", key, vector, *carry).write.mode("append").partitionBy("cell").parquet(f"{folder}/rows")


def _blocks_of(key_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                         T.StructField("ids", T.ArrayType(key_type)), T.StructField("codes", T.BinaryType())])


def search(spark: SparkSession, folder: str, questions: DataFrame, k: int = 3, query_id: str = "query_id", key: str = "chunk_id",
           vector: str = "embedding", carry: tuple = (), skip_same: bool = False, probes: int | None = None,
           shortlist: int | None = None) -> DataFrame:
    """The k nearest of the rows looked at: query id, `rank`, id, `distance` and carried columns. `questions` is a stored table.

    `skip_same` leaves out the row that has the question's own id.
    """
    ranked = measured(spark, folder, questions, query_id, key, vector, carry, skip_same, probes, shortlist)
    order = Window.partitionBy(query_id).orderBy(F.round("distance", _PLACES), key)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        query_id, "rank", key, "distance", *carry)


def measured(spark: SparkSession, folder: str, questions: DataFrame, query_id: str = "query_id", key: str = "chunk_id",
             vector: str = "embedding", carry: tuple = (), skip_same: bool = False, probes: int | None = None,
             shortlist: int | None = None) -> DataFrame:
    """All rows that a search measures exactly: the shortlist of each question, with their distances."""
    model = load(spark, folder)
    probes = min(probes or model.probes, len(model.centres))
    shortlist = (shortlist or model.shortlist) + skip_same
    asked = _usable(questions.select(query_id, vector), vector, model.width)
    id_type = asked.schema[query_id].dataType

    def packs(batches):
        for b in batches:
            points = _matrix(b.column(vector), model.width)
            near = model.cells_of(points)
            chosen = np.argpartition(near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(
                np.arange(near.shape[1]), (len(points), 1))
            who, cell = np.repeat(np.arange(len(points)), probes), chosen.reshape(-1)
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
            firsts = np.flatnonzero(np.diff(cell, prepend=-1))
            for begin, end in zip(firsts, [*firsts[1:], len(cell)]):
                for at in range(begin, end, PACK_ROWS):
                    taken = b.take(pa.array(who[at : min(end, at + PACK_ROWS)]))
                    whole = pa.array([0, taken.num_rows], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell[at]], pa.int32()), pa.ListArray.from_arrays(whole, taken.column(query_id)),
                         pa.array([_matrix(taken.column(vector), model.width).tobytes()], pa.binary())], names=["cell", "asked", "vectors"])

    packed = asked.mapInArrow(packs, T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("asked", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType())]))
    # At most as many numbers as there are cells; partitions of other cells are not read.
    wanted = sorted(r.cell for r in packed.select("cell").distinct().collect())
    row_schema = T.StructType.fromJson(json.loads(model.row_schema))
    row_type = row_schema[key].dataType
    codes = spark.read.schema(_blocks_of(row_type)).parquet(f"{folder}/codes").where(F.col("cell").isin(wanted))
    rows = spark.read.schema(row_schema).parquet(f"{folder}/rows").where(F.col("cell").isin(wanted))
    found_type = T.StructType([T.StructField(query_id, id_type), T.StructField("cell", T.IntegerType()),
                               T.StructField(key, row_type), T.StructField("coded", T.FloatType())])

    def nearest_codes(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell, ids, who = b.column("cell")[i].as_py(), b.column("ids")[i].values, b.column("asked")[i].values
                points = np.frombuffer(b.column("vectors")[i].as_py(), dtype=np.float32).reshape(len(who), -1)
                block = np.frombuffer(b.column("codes")[i].as_py(), dtype=np.uint8).reshape(len(ids), -1)
                squares = model.coded_squares(points, cell, block)
                n = min(shortlist, len(ids))
                best = np.argpartition(squares, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(who), 1))
                near = np.take_along_axis(squares, best, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [who.take(pa.array(np.repeat(np.arange(len(who)), n))), pa.array(np.full(n * len(who), cell), pa.int32()),
                     ids.take(pa.array(best.reshape(-1))), pa.array(near.reshape(-1).astype(np.float32))], names=found_type.names)

    shards = codes.groupBy("cell").agg(F.max("shard").alias("last"))
    laid = packed.join(shards, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    coded = laid.join(codes, ["cell", "shard"]).select("cell", "asked", "vectors", "ids", "codes").mapInArrow(nearest_codes, found_type)
    order = Window.partitionBy(query_id).orderBy("coded", key)
    best = coded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shortlist).select(query_id, "cell", key)
    if skip_same:
        best = best.where(F.col(query_id) != F.col(key))
    met = best.join(rows, ["cell", key]).join(asked.select(query_id, F.col(vector).alias("q_vector")), query_id)
    exact = lambda c: F.transform(c, lambda x: x.cast("double"))
    squares = F.zip_with(exact("q_vector"), exact(vector), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    return met.select(query_id, key, distance.alias("distance"), *carry)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", key: str = "chunk_id") -> float:
    """The share of the rows of an exact answer that a search found. 1 where there was nothing to find."""
    hit = exact.select(query_id, key).join(found.select(query_id, key).withColumn("hit", F.lit(1)), [query_id, key], "left")
    n, hits = hit.agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else 1.0
