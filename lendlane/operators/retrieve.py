"""Policy passages for applications: by keyword, or by nearest vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.text import present
from lendlane.operators.embed import Embedder
from lendlane.operators import vector_index
from lendlane.operators.nearest import nearest
from lendlane.operators.skew import join_unique

# Words that call up a passage, in passage order, and the passage without any.
KEYWORD_PASSAGES = [
    (("income",), "Loan Policy Section 2.1: Monthly income must exceed INR 30,000 baseline. "
                  "Prefer INR 50,000+ for standard terms."),
    (("credit", "score"), "Loan Policy Section 3.2: Credit score must be >= 600. "
                          "Scores >= 750 receive premium pricing benefits."),
    (("age",), "Loan Policy Section 1.5: Applicants must be between 21 and 60 years old at application date."),
    (("liability", "emi", "debt"), "Loan Policy Section 4.4: Debt-to-income (DTI) ratio must be <= 40% "
                                   "including the requested loan EMI."),
]
GENERAL_PASSAGE = (
    "General Policy Guidelines: All loan eligibility relies on rules, age restrictions, and credit scores."
)
KEYWORD_CONFIDENCE = 0.5
# What a disabled or empty retrieval returns, and the confidence of an index that gives no distances.
DISABLED_POLICY = "RAG retrieval is disabled."
NOTHING_FOUND = "No matching documents found."
INDEX_CONFIDENCE = 0.85
# Fixed value: passages per query.
TOP_K = 3
# Where passages come from.
DISABLED, KEYWORD, VECTORS, INDEX = "disabled", "keyword", "vectors", "index"


def retrieval_query(employment: Column, age: Column, credit: Column) -> Column:
    """The question asked of the policy, from the values as they were given (`None` where there are none)."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(
        F.lit("loan eligibility criteria for "), said(employment),
        F.lit(" age "), said(age), F.lit(" credit score "), said(credit),
    )


def _result(policy: Column, documents: Column, confidence: Column) -> Column:
    return F.struct(policy.alias("policy"), documents.alias("documents"), confidence.alias("confidence"))


def by_keyword(df: DataFrame, query: Column, output: str = "retrieved") -> DataFrame:
    """Add the passages whose words occur in the query.

    Row-local, so the few passages never become a join; in steps, so that each
    is worked out once per row.
    """
    lowered = df.withColumn("k_query", F.lower(query))
    says = lambda words: reduce(lambda a, b: a | b, [F.contains(F.col("k_query"), F.lit(w)) for w in words])
    hits = present(*[F.when(says(words), passage) for words, passage in KEYWORD_PASSAGES])
    found = lowered.withColumn("k_hits", hits).withColumn(
        "k_documents", F.when(F.size("k_hits") > 0, F.col("k_hits")).otherwise(F.array(F.lit(GENERAL_PASSAGE)))
    )
    documents = F.col("k_documents")
    result = _result(F.array_join(documents, "\n\n"), documents, F.lit(KEYWORD_CONFIDENCE))
    return found.withColumn(output, result).drop("k_query", "k_hits", "k_documents")


def disabled() -> Column:
    return _result(F.lit(DISABLED_POLICY), F.array().cast("array<string>"), F.lit(0.0))


def distance_confidence(mean_distance: Column) -> Column:
    """1 for no distance, falling to 0 at a mean distance of 2."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean_distance / 2.0)), 2)


def gather(neighbours: DataFrame, query_id: str, text: str = "text", fixed_confidence: bool = False) -> DataFrame:
    """Per query: passages in rank order, their concatenation, and the confidence. At most k rows per group."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    grouped = neighbours.groupBy(query_id).agg(ranked.alias("ranked"), F.avg("distance").alias("mean_distance"))
    documents = F.transform(F.col("ranked"), lambda r: r.getField("text"))
    confidence = F.lit(INDEX_CONFIDENCE) if fixed_confidence else distance_confidence(F.col("mean_distance"))
    return grouped.select(query_id, _result(F.array_join(documents, "\n\n"), documents, confidence).alias("retrieved"))


def by_vector(df: DataFrame, query: str, corpus: DataFrame | None, embedder: Embedder, spread_by: str, k: int = TOP_K,
              fixed_confidence: bool = False, index: str | None = None, **nearest_options) -> DataFrame:
    """Add `retrieved` to every row of `df` by the text in column `query`.

    `index` names a stored `vector_index` of the corpus, with its texts, to ask instead of searching the whole corpus.

    Equal questions are asked once: applications differ far more than the
    questions about them. The answers are joined back on the question, which may
    well be a hot key, hence the skew-proof join; `spread_by` tells the rows of one question apart.
    """
    questions = embedder.embed(df.select(query).where(F.col(query).isNotNull()).distinct(), query)
    if index is None:
        found = nearest(questions, corpus, k, query_id=query, carry=("text",), **nearest_options)
    else:
        found = vector_index.search(df.sparkSession, index, questions, k, query, carry=("text",), **nearest_options)
    answers = gather(found, query, fixed_confidence=fixed_confidence)
    joined = join_unique(df, answers, query)
    nothing = _result(F.lit(NOTHING_FOUND), F.array().cast("array<string>"), F.lit(0.0))
    return joined.withColumn("retrieved", F.coalesce(F.col("retrieved"), nothing))


def retrieve(df: DataFrame, query: str, backend: str = KEYWORD, corpus: DataFrame | None = None,
             embedder: Embedder | None = None, spread_by: str = "", **options) -> DataFrame:
    """Add `retrieved` by the backend named: no passages, the keyword table, vectors, or an index without distances."""
    if backend == DISABLED:
        return df.withColumn("retrieved", disabled())
    if backend == KEYWORD:
        return by_keyword(df, F.col(query))
    if backend not in (VECTORS, INDEX):
        raise ValueError(f"no such backend: {backend}")
    if (corpus is None and options.get("index") is None) or embedder is None:
        raise ValueError(f"{backend} needs a corpus and its embedder")
    return by_vector(df, query, corpus, embedder, spread_by, fixed_confidence=backend == INDEX, **options)
