"""SimHash groups, cap filters and components against brute force."""

import numpy as np
import pytest

from llm_tables import documents, no_docs, odd_docs  # noqa: F401

from lendlane.llm import cap_filters, components, vp_simhash


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    expected = {k: c for k, c in enumerate(groups(600, pairs)) if c != k}
    assert got == expected
    assert components.components(edges.limit(0)).count() == 0


def fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_pairs_are_all_found():
    random = np.random.default_rng(5)
    centres = random.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (3000, 3)).astype(np.uint64)
    points = np.unique(np.concatenate([random.integers(0, 2**63, 3000, dtype=np.uint64), centres[random.integers(0, 60, 3000)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]]))
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    expected = {(int(points[a]), int(points[b])) for a, b in zip(i, j)}
    found = set()
    for a, b in vp_simhash.near_pairs(points, points, 2):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert found == expected
    # The shards of the global tree lose no pair either, and each point has one home.
    nodes = vp_simhash.grow(points[::7], 20)
    home, seen = np.zeros(len(points), int), set()
    for _, index, own in vp_simhash.route(nodes, points, 2):
        home[index[own]] += 1
        here = points[index]
        for a, b in vp_simhash.near_pairs(here[own], here, 2):
            seen |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert (home == 1).all() and seen == expected


@pytest.mark.parametrize("shard_points", [8192, 16])
def test_documents_are_grouped_as_by_brute_force(documents, odd_docs, shard_points):
    docs = documents.select("doc_id", "text").unionByName(odd_docs.where("doc_id is not null").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])
    marks = [fingerprint(t) for _, t in rows]
    points = np.array(marks, dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    root = groups(len(rows), zip(i.tolist(), j.tolist()))
    expected = {(rows[k][0], f"{marks[k]:016x}", rows[root[k]][0]) for k in range(len(rows))}
    got = vp_simhash.near_duplicates(docs, shard_points=shard_points).collect()
    assert {tuple(r) for r in got} == expected and len(got) == docs.count()
    kept = vp_simhash.first_of_groups(docs, shard_points=shard_points).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in expected})


def test_first_of_groups_of_odd_rows(odd_docs, no_docs):
    kept = vp_simhash.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert [r.doc_id for r in rows if r.text == "The cat sat."] == [4] and sum(r.doc_id in (0, 1, 2) for r in rows) == 1
    assert vp_simhash.first_of_groups(no_docs).count() == vp_simhash.near_duplicates(no_docs).count() == 0


def plain_links(vectors):
    usable = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in vectors]
    pairs = []
    for a in range(len(vectors)):
        for b in range(a):
            if usable[a] and usable[b] and vectors[a][2] == vectors[b][2] and len(vectors[a][1]) == len(vectors[b][1]):
                x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    pairs.append((b, a))
    return pairs


@pytest.mark.parametrize("block_vectors", [2000, 8])
def test_vectors_are_linked_as_by_brute_force(spark, block_vectors):
    random = np.random.default_rng(9)
    vectors = []
    for k in range(40):
        centre = random.normal(size=16)
        vectors += [(None, (centre + random.normal(size=16) * 0.02).astype(np.float32).tolist(), k % 3) for _ in range(k % 7)]
        vectors += [(None, centre.astype(np.float32).tolist(), k % 3)] * (k % 3)
    nan, inf = float("nan"), float("inf")
    vectors += [(None, v, 0) for v in (None, [], [0.0] * 16, [nan] * 16, [inf] + [0.0] * 15, [None] + [1.0] * 15, [1.0], [-2.0], [3.0], [1e30] * 16, [1e30] * 16)]
    vectors += [(None, [1.0] * 16, None)] * 2
    vectors = [(i, v, l) for i, (_, v, l) in enumerate(vectors)]
    pairs = plain_links(vectors)
    root = groups(len(vectors), pairs)
    n_links = np.bincount(np.array(pairs).ravel(), minlength=len(vectors))
    table = spark.createDataFrame([(*v, "clash", 1) for v in vectors], "vec_id long, embedding array<float>, label int, rep string, copies int")
    got = {r.vec_id: r for r in cap_filters.linked_vectors(table, block_vectors=block_vectors).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (int(n_links[i]), root[i], root[i] == i) for i in range(len(vectors))}
    assert cap_filters.linked_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("length, filters", [(64, 4096), (64, 1 << 17), (3, 4096), (1, 4096)])
def test_vectors_side_by_side_have_the_filters_of_each(length, filters):
    units = cap_filters.unit_vectors(np.random.default_rng(8).normal(size=(70, length)))
    codes = cap_filters.Codes(length, filters)
    counts, numbers = codes.decode_rows(units)
    assert len(units) == len(counts) and [n.tolist() for n in np.split(numbers, np.cumsum(counts)[:-1])] == [codes.decode(u).tolist() for u in units]


def test_a_vector_is_sent_to_few_groups(spark):
    reps = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("label", "embedding", "vec_id as rep", "1L as copies")
    reps = cap_filters.stored(reps, "t")
    filters, group = cap_filters.sizes(reps, cap_filters.FILTERS_EACH, cap_filters.BLOCK_VECTORS)
    sent = cap_filters.in_blocks(cap_filters.filtered(reps, filters), group).count() / reps.count()
    assert sent < 12


def test_recall_at_the_threshold():
    random = np.random.default_rng(2)
    code = cap_filters.Codes(64, cap_filters.LEAST_FILTERS)
    met = total = listed = 0
    for _ in range(600):
        a, b = random.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        x, y = code.decode(a), code.decode(0.93 * a + np.sqrt(1 - 0.93**2) * b)
        met += len(np.intersect1d(x, y)) > 0
        listed += len(x)
        total += 1
    assert met / total >= 0.99 and 20 <= listed / total <= 50


@pytest.mark.parametrize("filters", [4097, 1 << 16, 1 << 20])
def test_recall_around_steps_in_the_number_of_codes(filters):
    random = np.random.default_rng(4)
    code = cap_filters.Codes(64, filters)
    met = 0
    for _ in range(1500):
        a, b = random.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        met += len(np.intersect1d(code.decode(a), code.decode(0.93 * a + np.sqrt(1 - 0.93**2) * b))) > 0
    assert met / 1500 >= 0.99


@pytest.mark.parametrize("n, copies", [(235_000, 2), (4_000_000, 5)])
def test_a_point_asks_in_few_shards(n, copies):
    random = np.random.default_rng(n)
    shards = -(-n // vp_simhash.SHARD_POINTS)
    sample = random.integers(0, 2**64, max(vp_simhash.LEAST_SAMPLE, vp_simhash.SAMPLE_EACH * shards), dtype=np.uint64)
    points = random.integers(0, 2**64, min(n, 500_000), dtype=np.uint64)
    visits = [(len(index), int(own.sum())) for _, index, own in vp_simhash.route(vp_simhash.grow(sample, shards), points, 2)]
    assert sum(own for _, own in visits) == len(points) and sum(v for v, _ in visits) <= copies * len(points)
    assert max(own for _, own in visits) * n / len(points) < 3 * vp_simhash.SHARD_POINTS


def test_crowded_shards_are_met_by_several_tasks(spark):
    random = np.random.default_rng(6)
    points = np.unique(np.concatenate([random.integers(0, 2**40, 400), *[np.int64(1) << random.integers(0, 40, 200)]]))
    points = np.unique(np.concatenate([points, points[:150] ^ 9, points[:90] ^ 64]))
    given = spark.createDataFrame([(int(p),) for p in points], "fingerprint long")
    near = lambda **how: {(r.node, r.component) for r in components.components(vp_simhash.links(given, **how)).collect()}
    assert near() == near(shard_points=40, block_questions=1 << 17) == near(shard_points=40, block_questions=25) != set()
