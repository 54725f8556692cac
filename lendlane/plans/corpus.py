"""Building the policy corpus: texts, passages, vectors, table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.config import DEFAULT_RULES, Rules
from lendlane.operators.chunk import explode_chunks, policy_lines, recursive_chunks
from lendlane.operators.embed import Embedder
from lendlane.sources import policy, tables

# Names the two documents go by.
POLICY_SOURCE = "policy"
RULES_SOURCE = "rules"


def policy_documents(spark: SparkSession, policy_path: str | None = None, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The policy text and the rules rendered as text, one row each: source, text."""
    texts = policy.policy_text(spark, policy_path).select(F.lit(POLICY_SOURCE).alias("source"), "text")
    as_text = spark.range(1).select(F.lit(RULES_SOURCE).alias("source"), F.lit(rules.as_text()).alias("text"))
    return texts.unionByName(as_text)


def passages(documents: DataFrame, key: str = "source") -> DataFrame:
    """One row per passage: chunk_id, source, text."""
    chunked = explode_chunks(documents, key, recursive_chunks()(F.col("text")))
    return chunked.select(
        F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.col(key).cast("string").alias("source"), "text",
    )


def build_corpus(documents: DataFrame, key: str = "source") -> tuple[DataFrame, Embedder]:
    """Passages with vectors, and the embedder that questions must go through as well."""
    cut = passages(documents, key)
    embedder = Embedder().fit(cut)
    return embedder.embed(cut), embedder


def save_corpus(corpus: DataFrame, table: str, format: str = "parquet") -> None:
    tables.overwrite(corpus.select("chunk_id", "text", F.col("embedding").cast("array<float>")), table, format)


def load_corpus(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def ensure_policy_lines(spark: SparkSession, table: str, pages: DataFrame, format: str = "parquet") -> bool:
    """Create the table of policy lines unless it exists; the built-in lines stand in for an empty source."""
    def lines() -> DataFrame:
        found = policy_lines(pages).select("chunk_id", "text")
        return policy.builtin_lines(spark) if found.isEmpty() else found

    return tables.create_if_absent(spark, table, lines, format)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))
