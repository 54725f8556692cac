import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlane.catalog.queries import QUERIES
from lendlane.operators import chunk, retrieve
from lendlane.operators.embed import Embedder, term_slots
from lendlane.operators.hashed_nearest import directions, nearest_hashed
from lendlane.operators.nearest import nearest
from lendlane.operators.skew import join_unique
from lendlane.plans import corpus as corpora
from lendlane.session import shared_folder

BROADCAST = {"way": "broadcast"}
BLOCKS = {"way": "blocks", "block_rows": 16, "pack_rows": 8, "pivots": 5, "block_copies": 3}


def vectors(spark, matrix, name, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def brute(queries, corpus, k, skip_same):
    out = set()
    for i, q in enumerate(queries):
        d = np.sqrt(((corpus - q) ** 2).sum(1))
        order = sorted((round(float(x), 9), j) for j, x in enumerate(d) if not (skip_same and j == i))
        out |= {(i, r + 1, j, round(x, 6)) for r, (x, j) in enumerate(order[:k])}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 6)) for r in df.collect()}


@pytest.mark.parametrize("way", [BROADCAST, BLOCKS])
@pytest.mark.parametrize("shape", ["random", "clusters", "copies"])
@pytest.mark.parametrize("skip_same", [False, True])
def test_nearest_equals_brute_force(spark, way, shape, skip_same):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(120, 6))
    if shape == "clusters":
        matrix = matrix * 0.01 + rng.integers(0, 4, size=(120, 1)) * 10
    if shape == "copies":
        # A third of the corpus is one and the same vector.
        matrix[40:80] = matrix[40]
    queries, corpus = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "chunk_id")
    assert found(nearest(queries, corpus, 4, skip_same=skip_same, **way)) == brute(matrix, matrix, 4, skip_same)


@pytest.mark.parametrize("way", [BROADCAST, BLOCKS])
def test_nearest_with_few_or_no_rows(spark, way):
    matrix = np.eye(3)
    queries, corpus = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "chunk_id")
    assert found(nearest(queries, corpus, 9, **way)) == brute(matrix, matrix, 9, False)
    assert nearest(queries, corpus.limit(0), 2, **way).count() == 0
    assert nearest(queries.limit(0), corpus, 2, **way).count() == 0


@pytest.mark.parametrize("way", [BROADCAST, BLOCKS])
def test_nearest_carries_columns(spark, way):
    corpus = vectors(spark, np.eye(3), "chunk_id").withColumn("text", F.concat(F.lit("t"), F.col("chunk_id")))
    rows = nearest(vectors(spark, np.eye(3), "query_id"), corpus, 1, carry=("text",), **way).collect()
    assert sorted((r["query_id"], r["text"]) for r in rows) == [(0, "t0"), (1, "t1"), (2, "t2")]


def test_broadcast_refuses_a_large_corpus(spark):
    rows = vectors(spark, np.eye(3), "chunk_id")
    with pytest.raises(ValueError, match="too large"):
        nearest(vectors(spark, np.eye(3), "query_id"), rows, way="broadcast", broadcast_bytes=10)


def test_hashed_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    # Three near copies of each centre.
    matrix = np.repeat(centres, 4, axis=0) + rng.normal(size=(160, 16)) * 0.02
    queries, corpus = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "chunk_id")
    expected = brute(matrix, matrix, 3, True)
    got = found(nearest_hashed(queries, corpus, 16, skip_same=True))
    assert len(got & expected) >= 0.9 * len(expected)
    odd = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, embedding array<double>")
    assert nearest_hashed(odd, corpus, 16).count() == 0
    assert nearest_hashed(queries, corpus.limit(0), 16).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_hashed_neighbours_of_the_embeddings_table(spark, sf):
    pairs = lambda name: {(r.query_id, r.chunk_id) for r in QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    exact = pairs("knn_exact")
    assert len(pairs("knn_hashed") & exact) >= 0.9 * len(exact) > 0


def test_join_unique_with_hot_keys(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    for how in ("left", "inner"):
        plain = sorted(left.join(right, "k", how).select("id", "k", "v").collect())
        assert sorted(join_unique(left, right, "k", how).select("id", "k", "v").collect()) == plain


def test_policy_lines_number_through_pages(spark):
    pages = [(s, p, "\n".join([f"a line long enough to keep {s} {p} {i}" for i in range((p * 7 + s) % 4)] + ["short"]))
             for s in range(2) for p in range(25)]
    # The second source has no name.
    df = spark.createDataFrame([(f"s{s}" if s == 0 else None, p, t) for s, p, t in pages], "source string, page long, text string")
    expected, index = set(), {}
    for s, p, text in pages:
        for line in text.split("\n"):
            if len(line.strip()) > 20:
                i = index.get(s, 0)
                expected.add((f"s{s}" if s == 0 else None, f"pdf_p{p}_{i}", f"Page {p + 1}: {line}"))
                index[s] = i + 1
    for block in (3, 4096):
        got = chunk.policy_lines(df.repartition(5), page_block=block)
        assert {tuple(r) for r in got.select("source", "chunk_id", "text").collect()} == expected


def test_fixed_stride(spark):
    texts = ["", "x", "y" * 450, "z" * 451, "w" * 500, "é\n😀b" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for (i, got) in df.select("i", chunk.fixed_stride(F.col("t"))).collect():
        t = texts[i]
        assert got == [t[a:a + 500] for a in range(0, max(len(t), 1), 450)]


def test_recursive_chunks(spark):
    words = " ".join(f"word{i}" for i in range(400))
    texts = ["", "short", "a" * 1200, words, "first paragraph\n\n" + "b " * 200 + "\n\n" + "c " * 200, "one\n\ntwo\n\nthree", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {i: c for i, c in df.select("i", chunk.recursive_chunks()(F.col("t"))).collect()}
    assert got[0] == [] and got[6] == [] and got[1] == ["short"] and got[5] == ["one\n\ntwo\n\nthree"]
    # Nothing to cut at: windows that overlap by 50.
    assert [len(c) for c in got[2]] == [500, 500, 300] and "".join([got[2][0], *[c[50:] for c in got[2][1:]]]) == texts[2]
    assert all(len(c) <= 500 for c in got[3]) and all(c == c.strip() for c in got[3])
    # Every word is in some passage whole, and neighbours share some words.
    assert {w for c in got[3] for w in c.split()} == set(words.split())
    assert all(set(a.split()) & set(b.split()) for a, b in zip(got[3], got[3][1:]))
    assert got[4][0].startswith("first paragraph") and got[4][-1].startswith("c c")


def test_embedding(spark):
    texts = ["age limits apply", "income income limits", "Income, INCOME limits!", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    slots = {i: s for i, s in df.select("i", term_slots(F.col("text"))).collect()}
    m = len(texts)
    present = [{int(x) for x in slots[i]} for i in range(m)]
    expected = []
    for i in range(m):
        v = np.zeros(128)
        for x in slots[i]:
            v[int(x)] += np.log((m + 1) / (sum(int(x) in p for p in present) + 1))
        expected.append(v / np.linalg.norm(v) if v.any() else v)
    got = {r["i"]: r["embedding"] for r in Embedder().fit(df).embed(df).collect()}
    assert all(np.allclose(got[i], expected[i]) for i in range(m)) and got[1] == got[2]
    path = shared_folder(spark, "embedder")
    fitted = Embedder().fit(df)
    fitted.save(path)
    assert {r["i"]: r["embedding"] for r in Embedder.load(path).embed(df).collect()} == got


def test_policy_retrieval(spark):
    corpus, embedder = corpora.build_corpus(corpora.policy_documents(spark))
    passages = corpus.collect()
    assert {p["source"] for p in passages} == {corpora.POLICY_SOURCE, corpora.RULES_SOURCE}
    asked = spark.createDataFrame([(1, "credit bureau scores"), (2, "credit bureau scores"), (3, None)], "application_id int, question string")
    rows = {r["application_id"]: r["retrieved"] for r in retrieve.by_vector(asked, "question", corpus, embedder, spread_by="application_id").collect()}
    vector = np.array(embedder.embed(asked.limit(1), "question").first()["embedding"])
    distance = {p["chunk_id"]: float(np.linalg.norm(np.array(p["embedding"]) - vector)) for p in passages}
    best = sorted(distance, key=lambda c: (round(distance[c], 9), c))[:3]
    texts = {p["chunk_id"]: p["text"] for p in passages}
    assert rows[1]["documents"] == [texts[c] for c in best] and rows[1]["policy"] == "\n\n".join(rows[1]["documents"])
    assert rows[1]["confidence"] == pytest.approx(round(max(0, 1 - np.mean([distance[c] for c in best]) / 2), 2))
    assert rows[2] == rows[1] and rows[3]["documents"] == [] and rows[3]["policy"] == retrieve.NOTHING_FOUND
    fixed = retrieve.by_vector(asked, "question", corpus, embedder, spread_by="application_id", fixed_confidence=True, **BLOCKS)
    other = {r["application_id"]: r["retrieved"] for r in fixed.collect()}
    assert other[1]["documents"] == rows[1]["documents"] and other[1]["confidence"] == 0.85


def test_keywords(spark):
    asked = ["My INCOME and emi", "score", "management", "weather"]
    df = spark.createDataFrame([(a,) for a in asked], "q string")
    got = [r["retrieved"] for r in retrieve.by_keyword(df, F.col("q")).collect()]
    assert [[d[:30] for d in g["documents"]] for g in got] == [
        ["Loan Policy Section 2.1: Month", "Loan Policy Section 4.4: Debt-"], ["Loan Policy Section 3.2: Credi"],
        ["Loan Policy Section 1.5: Appli"], ["General Policy Guidelines: All"],
    ]
    assert {g["confidence"] for g in got} == {0.5}


def test_worker_functions_travel_by_value(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lendlane.operators.chunk import _passages
    from lendlane.operators.nearest import _closest, _Task

    # A Python that cannot import the package must still be able to load them.
    blob = cloudpickle.dumps((_passages, _closest, _Task(1, False, ["a"])))
    code = "import pickle, sys; f, *_ = pickle.loads(sys.stdin.buffer.read()); print(list(f('a b', 500, 50)))"
    done = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd=tmp_path, env={})
    assert done.stdout.decode().strip() == "['a b']", done.stderr.decode()[-300:]


def test_a_search_by_blocks_ships_a_query_once_a_slice(spark):
    from lendlane.operators import nearest as operator

    rng = np.random.default_rng(11)

    def packed(rows):
        """Bytes of vectors handed to the tasks, and the rows of the plan's exchanges before them."""
        seen = []
        original = operator.met
        operator.met = lambda both, *a, **b: seen.append(both) or original(both, *a, **b)
        try:
            matrix = rng.normal(size=(rows, 4))
            nearest(vectors(spark, matrix, "query_id"), vectors(spark, matrix, "chunk_id"), 3, skip_same=True, **BLOCKS)
        finally:
            operator.met = original
        return seen[0].agg(F.sum(F.octet_length("vectors"))).first()[0]

    # Three times the rows in three times the blocks: nine times the bytes, if each block met each pack by itself.
    assert packed(6000) <= 3.3 * packed(2000)


@pytest.mark.parametrize("way", [BROADCAST, BLOCKS])
def test_nearest_among_copies_repeated_ids_and_floats(spark, way):
    rng = np.random.default_rng(12)
    matrix = rng.normal(size=(400, 5)).astype(np.float32).astype(np.float64)
    matrix[50:300] = matrix[50]
    floats = lambda name: vectors(spark, matrix, name).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert found(nearest(floats("query_id"), floats("chunk_id"), 3, skip_same=True, **way)) == brute(matrix, matrix, 3, True)
    # All rows twice: one of a query's own is left out.
    twice = floats("chunk_id").unionAll(floats("chunk_id"))
    got = [(r["query_id"], r["chunk_id"]) for r in nearest(floats("query_id").where("query_id < 20"), twice, 3, skip_same=True, **way).collect()]
    assert len(got) == 60 and all((i, i) in got for i in range(20))


def test_hashed_neighbours_meet_in_slices_not_in_pairs_of_rows(spark):
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(300, 8))
    matrix[:120] = matrix[0]
    queries, corpus = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "chunk_id")
    cut = nearest_hashed(queries, corpus, 8, skip_same=True, tables=6, slice_rows=7)
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()
    signs = directions(8, 6)
    codes = ((np.einsum("nd,tbd->ntb", matrix, signs) >= 0) * (1 << np.arange(signs.shape[1]))).sum(2)
    expected = set()
    for i in range(300):
        other = [j for j in range(300) if j != i and (codes[j] == codes[i]).any()]
        order = sorted((round(float(np.sqrt(((matrix[j] - matrix[i]) ** 2).sum())), 9), j) for j in other)
        expected |= {(i, r + 1, j, round(x, 6)) for r, (x, j) in enumerate(order[:3])}
    assert found(cut) == expected
    assert found(nearest_hashed(queries, corpus, 8, skip_same=True, tables=6)) == expected
