import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlane.operators import nearest as operator
from lendlane.operators.embed import Embedder, term_counts, term_slots
from lendlane.operators.nearest import nearest


def vectors(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, embedding array<double>")


def brute(queries, corpus, k):
    out = set()
    for i, q in enumerate(queries):
        order = sorted((round(float(np.sqrt(((v - q) ** 2).sum())), 9), j) for j, v in enumerate(corpus))
        out |= {(i, r + 1, j, round(x, 6)) for r, (x, j) in enumerate(order[:k])}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 6)) for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    """Several slices, packs, parts and partitions of packs out of few rows."""
    for name, value in [("SCAN_BYTES", 8 * 12 * 40), ("SCAN_PACK", 16), ("SCAN_PART", 5), ("SCAN_QUERY_BYTES", 3000), ("_MERGED", 20), ("_MERGED_SLICES", 2), ("_TILE_ROWS", 70)]:
        monkeypatch.setattr(operator, name, value)


def test_a_corpus_whose_cells_leave_out_nothing_is_not_shuffled(spark, small, monkeypatch):
    rng = np.random.default_rng(21)
    matrix = np.abs(rng.normal(size=(300, 12))) * (rng.random((300, 12)) < 0.5)
    matrix[100:140] = matrix[100]
    queries, corpus = vectors(spark, matrix[:90], "query_id"), vectors(spark, matrix, "chunk_id").withColumn("text", F.concat(F.lit("t"), "chunk_id"))
    monkeypatch.setattr(operator, "met", lambda *a, **b: pytest.fail("packed for a shuffle"))
    got = nearest(queries.repartition(3), corpus.repartition(2), 4, carry=("text",))
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == brute(matrix[:90], matrix, 4)
    assert all(r["text"] == f"t{r['chunk_id']}" for r in got.collect())


def test_repeated_and_null_ids_of_a_scan(spark, small):
    rng = np.random.default_rng(22)
    matrix = rng.normal(size=(80, 12))
    ids = lambda name: F.when(F.col(name) != 7, F.col(name).cast("string")).alias(name)
    queries = vectors(spark, matrix[:10], "query_id").select(ids("query_id"), "embedding")
    corpus = vectors(spark, matrix, "chunk_id").select(ids("chunk_id"), "embedding")
    once = nearest(queries, corpus, 3).collect()
    assert Counter(r["query_id"] for r in once) == Counter([*map(str, range(7)), None, "8", "9"] * 3)
    assert all(r["chunk_id"] == r["query_id"] for r in once if r["rank"] == 1)
    # A query that comes twice is one query, whose matches come twice.
    twice = nearest(queries.unionAll(queries), corpus, 3).collect()
    assert Counter(r["query_id"] for r in twice) == Counter(r["query_id"] for r in once)
    assert all(r["chunk_id"] == r["query_id"] for r in twice if r["rank"] <= 2)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e8, 1e20])
def test_neighbours_closer_than_single_precision_tells(spark, scale):
    rng = np.random.default_rng(23)
    matrix = np.repeat(rng.normal(size=(30, 8)), 12, axis=0)
    matrix = (matrix + rng.normal(size=matrix.shape) * 1e-7) * scale
    task = operator._Task(3, False, ["q", "rank", "c", "distance"])
    held = task.slice(operator.pa.array(range(len(matrix))), matrix, [])
    q, c, _, rank = (np.concatenate(x) for x in zip(*operator._closest(matrix, held.vectors, None, 3, held.place)))
    for i in range(0, len(matrix), 17):
        exact = np.round(np.sqrt(((matrix - matrix[i]) ** 2).sum(1)), 9)
        order = np.lexsort((np.arange(len(matrix)), exact))[:3]
        assert held.ids.take(operator.pa.array(c[q == i])).to_pylist() == order.tolist()


def test_term_counts_are_those_of_the_slots(spark):
    texts = ["", "  .. ", "one two ONE", "Ünïcode straße ΣΑΣ İx 中文 ٣٤ a_b-c'd", "x" * 70000, "a\nb\tc d", "1² ½ é", "!lead trail!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    text = F.coalesce("text", F.lit(""))
    for dimensions in (128, 1000003):
        rows = df.select("i", term_slots(text, dimensions).alias("slots"), term_counts(text, dimensions).alias("counts")).collect()
        for r in rows:
            expected = sorted(Counter(map(int, r["slots"])).items())
            assert (r["counts"].size, list(zip(r["counts"].indices.tolist(), r["counts"].values.tolist()))) == (dimensions, expected), r["i"]
    word = int(hashlib.md5(b"two").hexdigest()[:4], 16) % 128
    assert term_counts.__doc__ and [r["counts"][word] for r in df.where("i = 2").select(term_counts(text).alias("counts")).collect()] == [1.0]


def test_stored_counts_are_not_counted_again(spark):
    df = spark.createDataFrame([(1, "age limits apply"), (2, "income limits"), (3, None)], "i int, text string")
    plain = {r["i"]: r["embedding"] for r in Embedder().fit(df).embed(df).collect()}
    embedder = Embedder()
    counted = embedder.counted(df).drop("text")
    got = embedder.fit(counted).embed(counted)
    assert {r["i"]: r["embedding"] for r in got.collect()} == plain
    assert not re.search("e_counts", " ".join(got.columns))


def test_only_so_many_equal_vectors_are_held(spark):
    rng = np.random.default_rng(24)
    matrix = rng.normal(size=(200, 6))
    matrix[20:60], matrix[60:64], matrix[64:70] = matrix[20], 0.0, -0.0
    assert set(np.flatnonzero(operator._maybe_repeated(matrix))) == set(range(20, 70))
    held = operator._Task(3, False, ["q", "rank", "c", "distance"]).slice(operator.pa.array(range(200)), matrix, [])
    assert held.ids.to_pylist() == [*range(23), *range(60, 63), *range(64, 67), *range(70, 200)]
