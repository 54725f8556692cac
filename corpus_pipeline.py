"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.llm import langid_crf, line_rules, mixing, packing, vp_simhash
from lendlane.llm.common import stored, whole_row

# Documents whose words have less than this mean probability, each of its own likeliest language, are in none that was learned.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those in no known language; a mixture of known ones is known.

    Labels of documents that are NULL are left so. If there is no label to learn from, only documents without letters go.
    """
    model = langid_crf.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid_crf.with_language(docs.select(whole_row(docs.columns).alias("row")), model, "label", "score", "clear", "row")
    known = (F.col("label") != langid_crf.UNDETERMINED) & (F.col("clear") >= LEAST_LANGUAGE)
    return judged.where(known).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take failing lines out of the texts and drop documents that fail."""
    return line_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return vp_simhash.first_of_groups(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, or runs of their words, as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the token ids of all rows in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

# Language, fingerprints and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
