"""The registered queries against SQL, and the pipeline's stages."""

import compare
import pytest
from pyspark.sql import functions as F
from llm_tables import SMALL, documents, no_docs, odd_docs  # noqa: F401

import corpus_pipeline
from lendlane.llm import langid_crf, line_rules
from lendlane.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SMALL), compare.connect(SMALL), ORACLES[name]) == []


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_pipeline(spark, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL).cache()
        kept[name] = [r.doc_id for r in after.select("doc_id").collect()]
        if name != "packing":
            assert after.columns == documents.columns
        docs = after
    ids = [r.doc_id for r in documents.collect()]
    assert set(kept["packing"]) == set(kept["mixing"]) <= set(kept["simhash_near_dedup"]) <= set(kept["quality_rules"]) <= set(kept["language_id"]) <= set(ids)
    rules = {r.doc_id: r.kept for r in line_rules.judge(documents).collect()}
    assert set(kept["quality_rules"]) == {i for i in kept["language_id"] if rules[i]}
    assert len(kept["simhash_near_dedup"]) == len(set(kept["simhash_near_dedup"])) < len(kept["quality_rules"])
    assert len(kept["language_id"]) > 0.99 * len(ids)


def test_mixed_languages_are_known(spark, documents):
    texts = {r.lang: r.text.split() for r in documents.where("lang is not null").orderBy("doc_id").collect() if len(r.text) > 2000}
    assert len(texts) > 2
    mixed = " ".join(w for words in texts.values() for w in words[:40])
    rows = spark.createDataFrame([(10**6, mixed, None, "x", len(mixed)), (10**6 + 1, "12 345 -", None, "x", 8)], documents.schema)
    model = langid_crf.learn(documents)
    assert langid_crf.with_language(rows, model).collect()[0].score < corpus_pipeline.LEAST_LANGUAGE
    after = corpus_pipeline.language(spark, documents.unionByName(rows), SMALL)
    assert [r.doc_id for r in after.where("doc_id >= 1000000").collect()] == [10**6]


def test_documents_stay_without_labels_to_learn_from(spark, odd_docs):
    rows = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    after = corpus_pipeline.language(spark, rows, SMALL)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(str(r.doc_id) for r in after.collect()) == sorted(str(r.doc_id) for r in rows.collect() if letters(r.text))


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            out.collect()


def test_stages_keep_columns_of_any_name(spark, odd_docs):
    good = F.when(F.col("doc_id") == 4, "This is a plain sentence, and it has quite enough different words in it to stay.").otherwise(F.col("text"))
    docs = odd_docs.withColumns({"text": good, "a.b": F.lit("dot"), "LANG_PRED": F.lit("upper"), "`tick`": F.lit("t"), "Label": F.lit(1), "clear": F.lit(2.0)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert {(r["a.b"], r["LANG_PRED"], r["`tick`"], r["Label"], r["clear"]) for r in out.collect()} == {("dot", "upper", "t", 1, 2.0)}
