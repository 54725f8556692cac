"""Range joins, tables merged by key, tiered index folders, figures with replacement and by day, and the stored vector index."""

import glob
import os
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lendlane.catalog import inputs
from lendlane.operators import decide, retrieve, vector_index
from lendlane.operators.nearest import nearest
from lendlane.operators.range_join import CLOSED, range_join
from lendlane.plans import corpus as corpora, kpi, kpi_days
from lendlane.sources import audit, keyed
from lendlane.streaming import chunk_sync, kpi_stream

INF, NAN = float("inf"), float("nan")


# --- ranges -----------------------------------------------------------------------------------------------------------

def holds(x, low, high, closed):
    if x is None or x != x or low != low or high != high or (low is not None and high is not None and low > high):
        return False
    with_low, with_high = CLOSED[closed]
    above = low is None or (x >= low if with_low else x > low)
    return above and (high is None or (x <= high if with_high else x < high))


@pytest.mark.parametrize("closed", sorted(CLOSED))
def test_range_join_equals_comparing_all(spark, closed):
    random.seed(closed)
    point = lambda: random.choice([random.uniform(-50, 50), random.randint(-5, 5) * 10.0, random.uniform(0, 1e-6), 1e9 * random.random()])
    values = [(i, point()) for i in range(200)] + [(200, None), (201, NAN), (202, INF), (203, -INF), (204, 10.0), (205, 10.0)]
    ranges = [(i, *sorted([point(), point()])) for i in range(80)] + [
        (80, None, 3.0), (81, 20.0, None), (82, None, None), (83, 10.0, 10.0), (84, 5.0, -5.0), (85, NAN, 1.0), (86, -INF, INF), (87, 1.0, NAN)]
    rows, bands = spark.createDataFrame(values, "id int, x double"), spark.createDataFrame(ranges, "band int, low double, high double")
    found = {(r.id, r.band) for r in range_join(rows, bands, "x", "low", "high", closed=closed).collect()}
    assert found == {(i, b) for i, x in values for b, low, high in ranges if holds(x, low, high, closed)}
    left = range_join(rows, bands, "x", "low", "high", "left", "id", closed)
    assert {(r.id, r.band) for r in left.collect()} == found | {(i, None) for i, _ in values if i not in {j for j, _ in found}}


def test_range_join_keeps_decimals_exact_and_meets_few_pairs(spark):
    rows = spark.range(20000).selectExpr("id", "CAST(id AS DECIMAL(38, 10)) / 1000 + 9007199254740993 AS x")
    bands = spark.range(10000).selectExpr("id AS band", "CAST(id AS DECIMAL(38, 10)) / 500 + 9007199254740993 AS low",
                                          "CAST(id AS DECIMAL(38, 10)) / 500 + 9007199254740993.0005 AS high")
    joined = range_join(rows, bands, "x", "low", "high")
    assert joined.count() == 10000 and joined.where("id <> 2 * band").count() == 0
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_range_join_with_nothing(spark):
    rows, none = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([], "band int, low double, high double")
    assert range_join(rows, none, "x", "low", "high").count() == 0
    assert [tuple(r) for r in range_join(rows, none, "x", "low", "high", "left", "id").collect()] == [(1, 2.0, None, None, None)]
    assert range_join(rows.where("false"), spark.createDataFrame([(1, None, None)], none.schema), "x", "low", "high").count() == 0
    with pytest.raises(ValueError):
        range_join(rows, rows, "x", "x", "x")


def test_terms_of_fractional_scores(spark):
    scores = spark.createDataFrame([(i, s) for i, s in enumerate([0.0, 29.99, 30.0, 79.9, 80.0, 90.0, 100.0])], "application_id int, score double")
    got = {r.score: (r.risk_category, r.processing_fee) for r in decide.terms_by_interval_join(scores).collect()}
    assert got[29.99][0] == "Very High" and got[30.0][0] == "High" and got[79.9] == ("Low", "1.0% - 2.0%")
    assert got[80.0] == ("Low", "0.5% - 1.0%") and got[100.0][0] == got[90.0][0] == "Very Low" and got[0.0][0] == "Very High"


# --- merging by key ---------------------------------------------------------------------------------------------------

LOG = "application_id string, timestamp string, decision string"


def filters_of(df):
    """The partition filters of the scans of a plan: other folders are not read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def files_of(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/rows/*/*.parquet")}


def test_a_small_batch_rewrites_little(spark, tmp_path):
    folder = str(tmp_path / "t")
    keyed.upsert(spark.range(5000).selectExpr("CAST(id AS STRING) AS application_id", "'1' AS timestamp", "'a' AS decision"), folder, "all", buckets=64)
    before = files_of(folder)
    few = spark.createDataFrame([("7", "2", "b"), ("8", "0", "late"), ("new", "1", "c")], LOG)
    assert keyed.upsert(few, folder, "few", buckets=64)
    after = files_of(folder)
    assert len(before.keys() - after.keys()) <= 3 and len(before.keys() & after.keys()) >= 61
    assert all(before[p] == after[p] for p in before.keys() & after.keys())
    rows = {r.application_id: r for r in keyed.read(spark, folder).collect()}
    assert len(rows) == 5001 and rows["7"].decision == "b" and rows["8"].decision == "a" and rows["new"].decision == "c"
    found = keyed.find(spark, folder, ["7", "new", "absent"], buckets=64)
    assert {r.application_id for r in found.collect()} == {"7", "new"}
    assert "key_bucket" in filters_of(found)


def test_a_batch_counts_once_and_a_broken_merge_goes_on(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame(list(rows), LOG)
    keyed.upsert(batch(("a", "1", "x"), ("b", "1", "x")), folder, "1", buckets=4)
    real = keyed._mark
    monkeypatch.setattr(keyed, "_mark", lambda s, m: real(s, m) if "/written/" in m else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        keyed.upsert(batch(("a", "2", "y")), folder, "2", buckets=4)
    monkeypatch.setattr(keyed, "_mark", real)
    # Run again, with its input gone: what was merged already is put in place.
    assert keyed.upsert(batch(), folder, "2", buckets=4)
    keyed.upsert(batch(("a", "3", "z")), folder, "3", buckets=4)
    assert not keyed.upsert(batch(("a", "2", "y")), folder, "2", buckets=4)
    assert {(r.application_id, r.decision) for r in keyed.read(spark, folder).collect()} == {("a", "z"), ("b", "x")}


# --- tiers of the index -----------------------------------------------------------------------------------------------

def test_twenty_syncs_leave_few_folders(spark, tmp_path):
    source, index, state = (str(tmp_path / n) for n in ("chunks", "index", "state"))
    shape, expected, most = "chunk_id string, text string, at long, gone boolean", {}, 0
    for i in range(20):
        rows = [("same", f"text {i}", i, False), (f"only {i}", "x", i, False), (f"only {i - 3}", None, i, True)]
        expected |= {"same": f"text {i}", f"only {i}": "x"}
        expected.pop(f"only {i - 3}", None)
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        chunk_sync.sync_chunks(spark.readStream.schema(shape).parquet(source), index, state, F.col("at"), F.col("gone"))
        most = max(most, len(chunk_sync.live_folders(spark, index)))
    assert most <= 6 and len(chunk_sync.live_folders(spark, index)) == 2
    assert {r.chunk_id: r.text for r in chunk_sync.current_index(spark, index).collect()} == expected
    assert len(chunk_sync.current_index(spark, index).inputFiles()) <= 4 * spark.sparkContext.defaultParallelism


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    index = str(tmp_path / "index")
    for folders, batch in (["a"], 0), (["a", "b"], 1), (["a", "b", "c"], 2), (["a", "b", "C"], 2):
        assert chunk_sync.live_folders(spark, index, batch) == (["a", "b"][:batch])
        chunk_sync._publish(spark, index, folders, batch)
    assert chunk_sync.live_folders(spark, index) == ["a", "b", "C"]


# --- figures ----------------------------------------------------------------------------------------------------------

def audit_rows(spark, rows):
    return spark.createDataFrame(rows, "application_id string, timestamp string, decision string, guardrail_status string, latency double")


def test_later_rows_take_back_what_earlier_ones_counted(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    ok, blocked = "Compliant", "Blocked (Input Guardrail)"
    batches = [
        [("a", "1", "Eligible", ok, 1.5), ("b", "1", "Not Eligible", blocked, None), ("a", "2", "Not Eligible", ok, 0.25), (None, "1", "Eligible", ok, 9.0)],
        [("b", "2", "Eligible", ok, 0.1), ("a", "1", "Eligible", ok, 7.0), ("c", None, "Eligible", None, 0.2), ("c", None, "Eligible", "Violation", 0.2)],
        [("c", "0", "Conditionally Eligible", ok, 0.3), ("b", "2", "Eligible", ok, 0.1)],
    ]
    log = audit_rows(spark, [])
    stream = lambda: spark.readStream.schema(log.schema).parquet(source)
    for rows in batches:
        part = audit_rows(spark, rows)
        part.write.mode("append").parquet(source)
        log = log.unionByName(part)
        found = kpi_stream.refresh_latest_kpis(spark, stream(), output=out, checkpoint=state).first()
        assert found == kpi.kpi_summary(audit.latest(log)).first()
    # Nothing new: the figures stay.
    assert kpi_stream.refresh_latest_kpis(spark, stream(), output=out, checkpoint=state).first() == found
    assert spark.read.parquet(out).count() <= 2


def test_figures_from_days_count_a_folder_once(spark, tmp_path):
    log, counters = str(tmp_path / "log"), str(tmp_path / "counters")
    rows = inputs.audit_rows(spark, SMALL)
    early = F.col("timestamp") < rows.agg(F.max("timestamp")).first()[0][:10]
    assert kpi_days.days_summary(spark, counters).first() == kpi.kpi_summary(rows.where("false")).first()
    kpi_days.append_by_day(rows.where(early), log, "1")
    first = kpi_days.refresh(spark, log, counters)
    assert first > 0 and kpi_days.refresh(spark, log, counters) == 0
    late = rows.where(~early).unionByName(rows.where(early).limit(1).withColumn("timestamp", F.lit(None).cast("string")))
    kpi_days.append_by_day(late, log, "2")
    kpi_days.append_by_day(late, log, "2")  # once more: the same
    assert 0 < kpi_days.refresh(spark, log, counters) < first + 3
    whole = rows.where(early).unionByName(late)
    assert kpi_days.days_summary(spark, counters).first() == kpi.kpi_summary(whole).first()
    recent = kpi_days.recent_from_days(spark, log, counters)
    assert recent.collect() == kpi.recent_transactions(rows).collect()
    day = rows.agg(F.max(F.substring("timestamp", 1, 10))).first()[0]
    assert f"(log_day#" in filters_of(recent) and f">= {day})" in filters_of(recent) or kpi_days.days_summary(spark, counters, day).first().total < kpi.RECENT
    one = kpi_days.days_summary(spark, counters, day, day).first()
    assert one == kpi.kpi_summary(rows.where(F.substring("timestamp", 1, 10) == day)).first()


def test_folders_are_counted_where_their_rows_are_read(spark, tmp_path):
    log = str(tmp_path / "log")
    kpi_days.append_by_day(inputs.audit_rows(spark, SMALL), log, "1")
    rows = kpi_days.read_log(spark, log)
    new = [tuple(r) for r in rows.select(kpi_days.DAY, kpi_days.BATCH).distinct().collect()]
    counted = kpi_days._counted(rows, new)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Coalesce" not in plan
    assert counted.rdd.getNumPartitions() == 1
    assert counted.agg(F.sum("total")).first()[0] == rows.count() and counted.count() == len(new)


# --- vector index -----------------------------------------------------------------------------------------------------

def table_of(spark, matrix, ids="chunk_id"):
    flat = pa.FixedSizeListArray.from_arrays(matrix.astype(np.float32).reshape(-1), matrix.shape[1]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({ids: np.arange(len(matrix)), "embedding": flat}))


def clustered(seed=1, n=6000, width=24, clusters=60):
    r = np.random.default_rng(seed)
    return r.standard_normal((clusters, width))[r.integers(0, clusters, n)] + 0.2 * r.standard_normal((n, width))


def test_index_finds_nine_in_ten_on_the_embeddings_table(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    model = vector_index.build(vectors, str(tmp_path / "i"))
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    found = vector_index.search(spark, str(tmp_path / "i"), asked, skip_same=True)
    assert vector_index.recall(found, nearest(asked, vectors, skip_same=True)) >= 0.9
    assert model.shortlist < 0.2 * model.indexed_rows


def test_index_of_clustered_vectors_reads_few_cells_and_takes_more_rows(spark, tmp_path):
    folder, matrix = str(tmp_path / "i"), clustered()
    vectors = table_of(spark, matrix).withColumn("text", F.concat(F.lit("t"), "chunk_id"))
    model = vector_index.build(vectors.where("chunk_id < 5000"), folder, carry=("text",))
    vector_index.append(vectors.where("chunk_id >= 5000"), folder, carry=("text",))
    asked = vectors.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding")
    found = vector_index.search(spark, folder, asked, skip_same=True, carry=("text",))
    assert found.where("text <> concat('t', chunk_id)").count() == 0 and found.count() == 3 * 300
    assert vector_index.recall(found, nearest(asked, vectors, skip_same=True)) >= 0.9
    assert model.probes < 0.2 * len(model.centres) and model.shortlist < 0.2 * 5000
    one = filters_of(vector_index.search(spark, folder, asked.limit(1).cache(), skip_same=True))
    assert one.count("cell#") >= 2 and ("IN (" in one or "INSET" in one or model.probes == 1)
    assert spark.read.parquet(f"{folder}/rows").count() == 6000


def test_crowded_cells_are_searched_in_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vector_index, "SHARD_BLOCKS", 2)
    vectors = table_of(spark, np.concatenate([np.ones((500, 6)), clustered(2, 500, 6, 5)]))
    folder = str(tmp_path / "i")
    vector_index.build(vectors, folder, cells=6)
    assert spark.read.parquet(f"{folder}/codes").agg(F.max("shard")).first()[0] > 10
    assert spark.read.parquet(f"{folder}/codes").selectExpr("max(size(ids))", "sum(size(ids))").first() == (8, 1000)
    found = vector_index.search(spark, folder, vectors.where("chunk_id % 50 = 3").withColumnRenamed("chunk_id", "query_id"), probes=6, shortlist=1000)
    exact = nearest(vectors.where("chunk_id % 50 = 3").withColumnRenamed("chunk_id", "query_id"), vectors)
    key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 6)) for r in rows.collect())
    assert key(found) == key(exact)


def test_index_of_odd_and_of_no_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 1.0]), (6, [NAN, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    vector_index.build(vectors, str(tmp_path / "i"))
    found = vector_index.search(spark, str(tmp_path / "i"), asked, k=5)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect()) == [(1, 1, 1), (1, 2, 5), (5, 1, 5), (5, 2, 1)]
    vector_index.build(vectors.where("false"), str(tmp_path / "none"))
    assert vector_index.search(spark, str(tmp_path / "none"), asked).count() == 0


def test_policy_passages_by_a_stored_index(spark, tmp_path):
    corpus, embedder = corpora.build_corpus(corpora.policy_documents(spark))
    vector_index.build(corpus.cache(), str(tmp_path / "i"), carry=("text",))
    asked = spark.createDataFrame([(1, "minimum age"), (2, "credit score of salaried"), (3, None)], "id int, question string")
    by = lambda **how: {r.id: r.retrieved for r in retrieve.retrieve(asked, "question", retrieve.VECTORS, embedder=embedder, spread_by="id", **how).collect()}
    assert by(index=str(tmp_path / "i"), probes=10**6, shortlist=10**6) == by(corpus=corpus)
