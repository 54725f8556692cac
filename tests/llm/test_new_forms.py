"""Fill-in-middle, piecewise hashes and vector codes against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from compare import connect, differences
from lendlane.llm import cover_tree_codes as codes, fim_rank as fim, piecewise_hash as hashes, queries
from llm_tables import SMALL, documents, no_docs, odd_docs  # noqa: F401

# --- fill-in-middle ---------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 126))
@settings(max_examples=200, deadline=None)
def test_rank_index_is_exact_and_segments_are_within_the_error(steps, error):
    offsets = np.cumsum(np.array(steps, dtype=np.int64))
    index = fim.RankIndex(offsets, error)
    ranks = np.arange(len(offsets))
    assert (index.offsets(ranks) == offsets).all()
    assert (np.abs(index.predict(ranks) - offsets) <= error + 1).all()


def test_rank_index_is_far_smaller_than_the_offsets():
    offsets = np.cumsum(np.random.default_rng(1).integers(1, 12, 100_000))
    index = fim.RankIndex(offsets)
    assert len(index.first) < len(offsets) / 200


@given(st.lists(st.text(alphabet="ab \n\t 　é𝄞<>", max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_boundaries_are_those_of_the_pattern(texts):
    offsets, n = fim.boundaries(texts)
    expected, start = [], 0
    for text in texts:
        expected += [start] + [start + m.end() for m in UNIT.finditer(text)]
        start += len(text)
    assert offsets.tolist() == expected and n.tolist() == [len(UNIT.findall(t)) for t in texts]


def plain_fim(doc_id, text, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_outputs_equal_a_plain_version_and_give_the_text_back(spark, odd_docs):
    marked = [(100 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<P", "S> <", "<<P", "a b c <M"] * 6)]
    docs = odd_docs.select("doc_id", "text", "size").unionByName(
        spark.createDataFrame(marked, "doc_id long, text string").withColumn("size", F.lit(0).cast("long")))
    found = fim.fill_in_middle(docs)
    given_rows = sorted((str(r.doc_id), *plain_fim(r.doc_id, r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()) == given_rows
    texts = sorted(r[0] for r in found.select(fim.restored(F.col("output"), F.col("form"))).collect())
    assert texts == sorted(r.text or "" for r in docs.collect())
    assert {r.form for r in found.collect()} == {"plain", "spm", "psm"}


def test_shares_and_seed_are_parameters(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'one two three four' AS text")
    forms = lambda **p: {r.form for r in fim.fill_in_middle(docs, **p).select("form").distinct().collect()}
    assert forms(fim_percent=0) == {"plain"} and forms(fim_percent=100, spm_percent=0) == {"psm"}
    first, second = (fim.fill_in_middle(docs, seed=s).agg(F.sum("prefix_chars")).first()[0] for s in (1, 2))
    assert first != second


# --- piecewise hashes -------------------------------------------------------------------------------------------------

def plain_fingerprint(text: bytes) -> str:
    def rolled(i):
        h = sum(text[i - k] * pow(hashes.ROLL, k, 1 << 32) for k in range(hashes.WINDOW) if i >= k) % (1 << 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        return h ^ (h >> 12)

    rolls = [rolled(i) for i in range(len(text))]
    ends = lambda bits: [i + 1 for i, h in enumerate(rolls) if h % (1 << min(bits, 33)) == 0 and bits < hashes.LEAST_BITS + 31]
    bits = hashes.LEAST_BITS
    while len(ends(bits)) >= hashes.MOST_PIECES:
        bits += 1

    def pieces(bits):
        out, cuts = "", sorted({0, *ends(bits), len(text)})
        for a, b in zip(cuts, cuts[1:]):
            h = sum((c + 1) * pow(hashes.BASE, k, 1 << 64) for k, c in enumerate(text[a:b])) % (1 << 64)
            h ^= h >> 32
            symbol = h * 0xD6E8FEB86659FD93 % (1 << 64) >> 52
            out += chr(hashes.ALPHABET[symbol >> 6]) + chr(hashes.ALPHABET[symbol & 63])
        return out

    return f"{1 << bits}:{pieces(bits)}:{pieces(bits + 1)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (n, *one), (m, *two) = a.split(":"), b.split(":")
    at = {int(n): one[0], 2 * int(n): one[1]}, {int(m): two[0], 2 * int(m): two[1]}
    best = 0.0
    for size in at[0].keys() & at[1].keys():
        x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (at[0][size], at[1][size]))
        best = max(best, 1 - plain_distance(x, y) / max(1, len(x), len(y)))
    return best


@pytest.fixture(scope="module")
def some_texts(documents):
    odd = ["", "a", "\0\0", "a" * 5000, "ab " * 3000, "é日本𝄞" * 40]
    return odd + [r.text or "" for r in documents.orderBy("doc_id").limit(60).collect()]


def test_fingerprints_equal_a_plain_version_also_slice_by_slice(some_texts, monkeypatch):
    raw = [t.encode() for t in some_texts]
    expected = [plain_fingerprint(t) for t in raw]
    assert hashes.fingerprint_all(raw) == expected
    monkeypatch.setattr(hashes, "SLICE", 500)
    assert hashes.fingerprint_all(raw) == expected


def test_pieces_are_bounded_and_a_long_text_counts_to_its_end():
    text = np.random.default_rng(5).integers(97, 123, 3 << 20).astype(np.uint8).tobytes()
    whole, other = hashes.fingerprint_all([text, text[:-5] + b"XXXXX"])
    assert len(whole.split(":")[1]) <= 2 * hashes.MOST_PIECES and whole != other
    assert hashes.likenesses([(whole, other)])[0] > 0.9


@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=64), st.lists(st.integers(0, 5), max_size=64)), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_edit_distances_equal_the_plain_ones(pairs):
    a, b = ([np.array(x, dtype=np.uint16) for x in side] for side in zip(*pairs))
    assert hashes.edit_distances(a, b).tolist() == [plain_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def plain_compared(rows):
    """Of rows whose (id, text) differ: by descending id, NULL last; rows of one id by the hash the operator uses."""
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mark, edited_mark, next_mark = (plain_fingerprint(t.encode()) for t in (text, edited, following))
        out.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark,
                    round(plain_likeness(mark, edited_mark), 9), round(plain_likeness(mark, next_mark), 9)))
    return sorted(out)


def found_rows(docs):
    found = hashes.compare_with_edited(docs).collect()
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                   round(r.near_next, 9)) for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_comparison_equals_a_plain_version(spark, documents, n):
    rows = [(r.doc_id, r.text or "") for r in documents.orderBy(F.desc("doc_id")).limit(n).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_rows(docs) == plain_compared(rows)


def test_odd_rows_are_all_compared_in_the_stated_order(odd_docs):
    keyed = odd_docs.where("length(text) < 10000 or text is null").withColumn("t", F.coalesce("text", F.lit("")))
    rows = keyed.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("t")).collect()
    assert found_rows(keyed.drop("t")) == plain_compared([(r.doc_id, r.t) for r in rows])


def test_a_hot_id_is_dealt_to_many_partitions_and_nothing_is_lost(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "concat('text number ', id % 5) AS text")
    found = hashes.compare_with_edited(docs)
    assert found.count() == 3000 and found.where("doc_id = 7").count() == 1001
    same = found.groupBy("n_chars", "fingerprint").count().count()
    assert same == 5


def test_no_documents_no_rows(no_docs):
    assert not hashes.compare_with_edited(no_docs).collect() and not fim.fill_in_middle(no_docs).collect()
    assert not hashes.fingerprints(no_docs).collect()


def test_compare_adds_a_likeness(spark):
    mark = plain_fingerprint(b"some text of a few words, no more")
    pairs = spark.createDataFrame([(mark, mark), (mark, None), (mark, "4::")], "a string, b string")
    assert [r.near for r in hashes.compare(pairs, "a", "b", "near").collect()] == [1.0, None, 0.0]


# --- vector codes -----------------------------------------------------------------------------------------------------

def plain_codes(vectors: np.ndarray, parts=8, entries=16, rounds=6):
    """Lloyd's rounds over all vectors and entries; `vectors` are whole numbers in order of their ids."""
    books = [np.array(vectors[:entries, p]) for p in range(parts)]
    nearest = lambda p: ((vectors[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p).argmin(axis=1)
            books[p] = np.array([vectors[own == e, p].sum(axis=0) // max(1, (own == e).sum()) if (own == e).any() else books[p][e]
                                 for e in range(len(books[p]))])
    distance = [nearest(p) for p in range(parts)]
    code = ["".join(f"{d[i].argmin():02x}" for d in distance) for i in range(len(vectors))]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    return code, sum(d.min(axis=1) for d in distance).tolist(), digest


@pytest.mark.parametrize("shape", ["even", "clustered", "few values"])
def test_trees_give_every_point_its_nearest_entry(shape):
    random = np.random.default_rng(3)
    centres = random.integers(-3000, 3000, (12, 8))
    points = {"even": random.integers(-500, 500, (3000, 8)), "few values": random.integers(0, 3, (3000, 8)),
              "clustered": centres[random.integers(0, 12, 3000)] + random.integers(-40, 40, (3000, 8))}[shape]
    tree = codes.Tree.unpacked(codes.Tree.grow(points).packed())
    book = np.concatenate([centres, points[:2], points[:2]])[-16:] if shape != "clustered" else np.concatenate([centres, centres[:4]])
    distance = codes.squared(points, book)
    own = distance.argmin(axis=1)
    code, error = tree.codes(book)
    assert (code == own).all() and (error == distance.min(axis=1)).all()
    n, sums = tree.statistics(book)
    assert n.tolist() == [int((own == e).sum()) for e in range(16)]
    assert all((sums[e] == points[own == e].sum(axis=0)).all() for e in range(16))
    begin, end, _ = tree.ranges(book)
    assert (np.sort(codes._spans(begin, end)) == np.arange(len(tree.points))).all()
    if shape == "clustered":  # whole subtrees are given away, most points are never looked at
        assert len(begin) < len(tree.points) / 10


def test_nodes_cover_their_points_and_children_are_apart():
    tree = codes.Tree.grow(np.random.default_rng(8).integers(-900, 900, (2000, 4)))
    for k in range(len(tree.centre)):
        here = tree.points[tree.begin[k] : tree.end[k]]
        own = codes.squared(here, tree.points[tree.centre[k]][None])[:, 0]
        assert np.sqrt(own.max()) <= tree.radius[k] + 1e-9
        children = tree.centre[tree.child[k] : tree.child[k] + tree.children[k]]
        apart = codes.squared(tree.points[children], tree.points[children]).astype(float)
        np.fill_diagonal(apart, np.inf)
        assert not len(children) or np.sqrt(apart.min()) > tree.radius[k] / 2


def test_codes_equal_a_plain_version_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_VECTORS", 50)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {r.vec_id: r for r in codes.compress(rows.repartition(5)).collect()}
    given = sorted((r.vec_id, r.embedding) for r in codes.usable(rows).collect())
    whole = np.floor(4096 * np.array([e for _, e in given])).astype(np.int64).reshape(len(given), 8, -1)
    code, error, digest = plain_codes(whole)
    assert [found[i].code for i, _ in given] == code and [found[i].error for i, _ in given] == error
    assert {r.codebooks_sha256 for r in found.values()} == {digest}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 16, 1), (2, None, 1), (3, [nan] * 16, 1), (4, [inf] + [0.0] * 15, 2), (5, [None] + [0.0] * 15, None),
            (None, [0.25] * 16, None), (6, [1.0] * 16, None), (6, [1.0] * 16, None), (7, [0.5] * 9, 1), (8, [], 1), (9, [1e30] * 16, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x"))
    found = codes.compress(vectors).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "6", "6", "7", "8", "9", "None"]
    kept = [r for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or [])) if r[1] is not None and r[0] not in (3, 4, 5)]
    whole = np.array([np.minimum(np.floor(4096 * np.array(r[1] + [0.0] * (16 - len(r[1])))), codes.LARGEST) for r in kept])
    code, error, digest = plain_codes(whole.astype(np.int64).reshape(len(kept), 8, 2))
    assert sorted(r.code for r in found) == sorted(code) and sorted(r.error for r in found) == sorted(error)
    by_label = {str(r[2]): 0 for r in kept}
    for r, e in zip(kept, error):
        by_label[str(r[2])] += e
    labels = {str(r[0]): str(r[2]) for r in kept}
    assert all(r.label_error == by_label[labels[str(r.vec_id)]] and r.codebooks_sha256 == digest for r in found)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert not codes.compress(empty).collect()
    blank = spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error) for r in codes.compress(blank).collect()] == [("00" * 8, 0)]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_cover_tree_codes"])
def test_queries_equal_their_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name])
