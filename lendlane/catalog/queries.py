"""The registered queries: every operator over whole tables, results flat and with fixed names."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.catalog import inputs
from lendlane.config import DEFAULT_RULES_DOCUMENT, Gates
from lendlane.functions import finance
from lendlane.functions.employment import normalize_employment
from lendlane.functions.numbers import parse_number, safe_float, safe_int
from lendlane.functions.text import clamp_text
from lendlane.operators import chat, chunk, decide, dynamic, frequencies, guards, history, phrases, report, retrieve, validate, vector_index
from lendlane.operators.applicants import Applicants, key_factors
from lendlane.operators.embed import Embedder
from lendlane.operators.hashed_nearest import nearest_hashed
from lendlane.operators.nearest import nearest
from lendlane.operators.range_join import range_join
from lendlane.plans import assess as assessing, corpus as corpora, kpi, kpi_days
from lendlane.plans.followup import followup_prompts
from lendlane.plans.tool import evaluate_json
from lendlane.session import shared_folder
from lendlane.sources import audit, customers, keyed, payload, policy, rules, tables
from lendlane.streaming import chunk_sync, kpi_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MODEL = "serving-model"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _listed(name: str) -> Column:
    return F.array_join(name, " | ").alias(name)


# --- sources -----------------------------------------------------------------

@query
def customer_scan_preview(spark, d):
    # Ordered, so that the five rows are the same five each time.
    return tables.preview(inputs.table(spark, d, "customer").orderBy("c_custkey")).select("c_custkey", "c_name", "c_acctbal")


@query
def ingest_counts(spark, d):
    docs = inputs.table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("rows"))


@query
def chunk_counts(spark, d):
    docs = inputs.documents(spark, d)
    return corpora.chunk_counts(chunk.explode_chunks(docs, "doc_id", chunk.fixed_stride(F.col("text")), "source"))


@query
def directory_lookup(spark, d):
    wanted = inputs.table(spark, d, "orders").select(
        "o_orderkey", F.format_string("Customer#%09d", F.col("o_custkey")).alias("name")
    )
    directory = inputs.table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_custkey", "c_mktsegment")
    return customers.lookup_by_name(wanted, directory, order_by="c_custkey", spread_by="o_orderkey")


@query
def payload_from_directory(spark, d):
    return customers.to_payload(inputs.applicants(spark, d))


def _job_payload(spark, d):
    return payload.typed_payload(inputs.raw_applicants(spark, d).drop("user_message", "session_id"))


@query
def job_payload(spark, d):
    return payload.accepted(_job_payload(spark, d))


@query
def job_rejects(spark, d):
    return payload.rejected(_job_payload(spark, d)).select("application_id", "loan_purpose")


# --- scalar functions --------------------------------------------------------

@query
def parse_numbers(spark, d):
    raw = inputs.raw_applicants(spark, d)
    names = ["age", "monthly_income", "credit_score", "monthly_loan_payment", "loan_amount_requested"]
    return raw.select("application_id", *[parse_number(F.col(n)).alias(n) for n in names],
                      parse_number(F.col("monthly_loan_payment"), 0).alias("payment_or_zero"))


@query
def safe_casts(spark, d):
    raw = inputs.raw_applicants(spark, d)
    return raw.select("application_id", safe_int(F.col("age")).alias("age"), safe_int(F.col("credit_score")).alias("credit_score"),
                      safe_float(F.col("monthly_income")).alias("monthly_income"))


@query
def employment_labels(spark, d):
    orders = inputs.table(spark, d, "orders")
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" o'neil-"), F.lower("o_orderpriority"))).when(
        F.col("o_orderkey") % 3 == 1, F.lit(" SELF EMPLOYED ")
    )
    return orders.select("o_orderkey", normalize_employment(spelled).alias("employment"))


@query
def clamped_text(spark, d):
    docs = inputs.documents(spark, d)
    return docs.select("doc_id", clamp_text(F.col("text")).alias("head"))


@query
def applicant_factors(spark, d):
    rows = Applicants(inputs.raw_applicants(spark, d)).with_factors()
    return rows.select("application_id", key_factors().alias("k")).select("application_id", "k.*")


@query
def ratios(spark, d):
    rows = Applicants(inputs.applicants(spark, d)).with_factors()
    return rows.select(
        "application_id", F.round(finance.debt_to_income(F.col("f_debt"), F.col("f_income")), 9).alias("dti"),
        F.round(finance.loan_multiple(F.col("f_requested"), F.col("f_income")), 9).alias("multiple"),
    )


# --- decisions ---------------------------------------------------------------

@query
def eligibility_verdict(spark, d):
    rows = decide.score_applicants(inputs.applicants(spark, d))
    return rows.select("application_id", "stage", "eligibility", _long("score"))


@query
def dynamic_verdicts(spark, d):
    rows = decide.score_applicants(dynamic.with_fields(inputs.dynamic_payloads(spark, d)))
    return rows.select("application_id", F.col("f_debt").alias("debt"), "stage", "eligibility", _long("score"))


@query
def score_breakdown(spark, d):
    rows = decide.score_applicants(inputs.applicants(spark, d))
    return rows.select("application_id", *[_long(f"p_{p}") for p in ("income", "credit", "debt", "employment", "request")],
                       _long("points"))


@query
def loan_terms(spark, d):
    return decide.evaluate(inputs.applicants(spark, d)).select("application_id", "estimated_terms.*")


@query
def terms_range_join(spark, d):
    scored = decide.score_applicants(inputs.applicants(spark, d)).select("application_id", "score")
    return decide.terms_by_band_join(scored).withColumn("score", F.col("score").cast("bigint"))


@query
def terms_interval_join(spark, d):
    scored = _kept(decide.score_applicants(inputs.applicants(spark, d)).select("application_id", "score"), "scores")
    return decide.terms_by_interval_join(scored).withColumn("score", F.col("score").cast("bigint"))


@query
def orders_in_bands(spark, d):
    # A band for each nation: overlapping, of very different widths, some a point, some open at an end, with decimal bounds.
    bands = inputs.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("band"),
        F.expr("CASE WHEN n_nationkey % 9 <> 4 THEN CAST(n_nationkey * 20000.25 AS DECIMAL(18, 2)) END").alias("band_low"),
        F.expr("""CASE WHEN n_nationkey % 11 <> 7 THEN CAST(n_nationkey * 20000.25 + n_nationkey % 5 * 9000.5
                                                           + n_nationkey % 3 * 70 AS DECIMAL(18, 2)) END""").alias("band_high"))
    orders = inputs.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return range_join(orders, bands, "price", "band_low", "band_high", "left", "o_orderkey").select("o_orderkey", "band")


@query
def reasons_and_steps(spark, d):
    return decide.evaluate(inputs.applicants(spark, d)).select("application_id", _listed("reasons"), _listed("next_steps"))


@query
def raw_eligibility(spark, d):
    rows = decide.evaluate(inputs.raw_applicants(spark, d))
    return rows.select("application_id", "stage", "eligibility", _long("score"), _listed("reasons"),
                       "required_income_for_eligibility")


@query
def strict_eligibility(spark, d):
    rows = decide.evaluate(inputs.raw_applicants(spark, d), strict=True)
    return rows.select(
        "application_id", "stage", "eligibility", _long("score"), _listed("reasons"), _listed("next_steps"),
        F.col("scoring_breakdown.income").cast("bigint").alias("income_points"), "estimated_terms.risk_category",
        "required_income_for_eligibility",
    )


@query
def what_if_income(spark, d):
    rows = Applicants(inputs.applicants(spark, d)).with_factors()
    return rows.select("application_id", decide.verdict_at_income(F.col("f_income") * 2).alias("verdict_if_doubled"))


@query
def required_income(spark, d):
    return decide.evaluate(inputs.applicants(spark, d)).select("application_id", "required_income_for_eligibility")


@query
def required_documents(spark, d):
    rows = decide.score_applicants(inputs.applicants(spark, d))
    return rows.select("application_id", F.array_join(decide.required_documents(F.col("eligibility")), " | ").alias("documents"))


@query
def evaluation_factors(spark, d):
    rows = decide.evaluate(inputs.raw_applicants(spark, d))
    return rows.select("application_id", F.array_join(report.evaluation_factors(), " | ").alias("factors"))


@query
def confidence(spark, d):
    rows = decide.evaluate(validate.validate_required(inputs.raw_applicants(spark, d)))
    return rows.select("application_id", decide.confidence(F.col("eligibility"), F.col("valid"), F.size("errors")).alias("confidence"))


# --- validation and guards ---------------------------------------------------

@query
def validate_required(spark, d):
    rows = validate.validate_required(inputs.raw_applicants(spark, d))
    said = validate.validation_reason(F.col("missing_fields"), F.col("errors")).alias("reason")
    return rows.select("application_id", "valid", _listed("missing_fields"), _listed("errors"), said)


@query
def validate_ranges(spark, d):
    return validate.validate_ranges(inputs.raw_applicants(spark, d)).select("application_id", _listed("errors"))


@query
def validate_preflight(spark, d):
    rows = validate.validate_preflight(inputs.raw_applicants(spark, d))
    return rows.select("application_id", _listed("errors"), "needs_more_info", "message")


@query
def input_guard(spark, d):
    return guards.check_applicants(inputs.raw_applicants(spark, d)).select("application_id", "blocked", "reason")


@query
def text_guard(spark, d):
    turns = inputs.turns_with(spark, d, inputs.PLANTED_INPUT)
    fields = F.array(F.struct(F.lit("text").alias("name"), F.col("text").alias("value")))
    checked = guards.input_guard(turns, fields, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return checked.select("conv_id", "turn", "blocked", "reason")


@query
def document_phrases(spark, d):
    """Every two words in a row of the benchmark, as a phrase table, searched for in all documents."""
    hits = phrases.first_phrase(inputs.documents(spark, d), ["source", "text"], inputs.benchmark_phrases(spark, d), whole_words=True)
    return hits.select("doc_id", "hit_field", "hit_place", "hit_phrase")


@query
def chat_guard(spark, d):
    turns = inputs.turns_with(spark, d, inputs.PLANTED_CHAT)
    return turns.select("conv_id", "turn", guards.chat_guard(F.col("text")).alias("refusal"))


@query
def guard_json_batch(spark, d):
    return guards.check_json_batch(inputs.payload_json(spark, d)).select("request_id", "blocked", "reason")


@query
def output_guard(spark, d):
    docs = inputs.documents_with(spark, d, inputs.PLANTED_PROMISES).withColumn("reasoning", F.col("text"))
    cleaned = guards.clean_output(docs)
    return cleaned.select("doc_id", "decision", "reasoning", "disclaimer", "guardrail_status")


@query
def chat_sanitize(spark, d):
    docs = inputs.documents_with(spark, d, inputs.PLANTED_PROMISES)
    return guards.clean_chat(docs, F.col("text")).select("doc_id", "response")


@query
def report_detect(spark, d):
    docs = inputs.documents_with(spark, d, inputs.PLANTED_REPORT)
    return docs.select("doc_id", guards.is_full_report(F.col("text")).alias("is_full_report"))


# --- corpus and retrieval ----------------------------------------------------

@query
def policy_lines(spark, d):
    # A source is the document, its documents are the pages.
    pages = inputs.documents(spark, d).withColumnRenamed("doc_id", "page")
    return chunk.policy_lines(pages)


def _chunk_ids(cut):
    return cut.withColumn("chunk_id", F.format_string("%d_%d", F.col("doc_id"), F.col("chunk_no")))


def _stride_chunks(spark, d):
    docs = inputs.documents(spark, d)
    cut = chunk.explode_chunks(docs, "doc_id", chunk.fixed_stride(F.col("text")))
    return _chunk_ids(cut)


@query
def chunk_fixed_stride(spark, d):
    return _stride_chunks(spark, d).select("chunk_id", "text")


@query
def chunk_recursive(spark, d):
    return corpora.passages(inputs.documents(spark, d), "doc_id").select("chunk_id", "text")


@query
def keyword_policy(spark, d):
    turns = inputs.turns_with(spark, d, inputs.PLANTED_QUESTIONS)
    return retrieve.by_keyword(turns, F.col("text"), "r").select(
        "conv_id", "turn", "r.policy", F.size("r.documents").cast("bigint").alias("documents"), "r.confidence"
    )


@query
def retrieval_query(spark, d):
    rows = inputs.raw_applicants(spark, d)
    asked = retrieve.retrieval_query(F.col("employment_type"), F.col("age"), F.col("credit_score"))
    found = retrieve.by_keyword(rows.select("application_id", asked.alias("query")), F.col("query"))
    return found.select("application_id", "query", "retrieved.policy")


def _neighbours(spark, d, **options):
    vectors = inputs.table(spark, d, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(asked, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), skip_same=True, **options)


@query
def knn_exact(spark, d):
    return _neighbours(spark, d).select("query_id", _long("rank"), "chunk_id", F.round("distance", 6).alias("distance"))


@query
def knn_blocked(spark, d):
    # Small blocks and packs, so that many of them meet.
    found = _neighbours(spark, d, block_rows=256, pack_rows=128, pivots=16, block_copies=3)
    return found.select("query_id", _long("rank"), "chunk_id", F.round("distance", 6).alias("distance"))


@query
def knn_hashed(spark, d):
    vectors = inputs.table(spark, d, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = nearest_hashed(asked, corpus, inputs.EMBEDDING_WIDTH, skip_same=True)
    return found.select("query_id", _long("rank"), "chunk_id", F.round("distance", 6).alias("distance"))


def _indexed(spark, d):
    """The table of vectors, an index over all of it, and every hundredth of its rows as questions."""
    vectors = inputs.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    folder = shared_folder(spark, "vector-index")
    model = vector_index.build(vectors, folder)
    return vectors, folder, model, vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query
def knn_indexed(spark, d):
    _, folder, _, asked = _indexed(spark, d)
    found = vector_index.search(spark, folder, asked, skip_same=True)
    return found.select("query_id", _long("rank"), "chunk_id", F.round("distance", 6).alias("distance"))


@query
def index_recall(spark, d):
    # What the index found, held against an exact search and against the vectors themselves.
    vectors, folder, model, asked = _indexed(spark, d)
    found = _kept(vector_index.search(spark, folder, asked, skip_same=True), "found")
    recall = vector_index.recall(found, nearest(asked, vectors, skip_same=True))
    other = asked.select("query_id", F.col("embedding").alias("q_embedding"))
    pairs = found.join(vectors, "chunk_id").join(other, "query_id")
    squares = F.aggregate(F.zip_with("embedding", "q_embedding", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)),
                          F.lit(0.0), lambda total, x: total + x)
    wrong = F.abs(F.sqrt(squares) - F.col("distance")) > 1e-9
    return pairs.agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("found"), F.count_if(wrong).alias("wrong_distances")).select(
        "questions", "found", "wrong_distances", F.lit(recall >= 0.9).alias("nine_in_ten_found"),
        F.lit(model.shortlist < 0.2 * model.indexed_rows).alias("few_rows_measured"))


@query
def retrieval_confidence(spark, d):
    means = _neighbours(spark, d).groupBy("query_id").agg(F.avg("distance").alias("mean_distance"))
    return means.select("query_id", retrieve.distance_confidence(F.col("mean_distance")).alias("confidence"))


def _kept(df, purpose):
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


@query
def tfidf_retrieval(spark, d):
    # The passages are cut and their terms counted once, and the index is built once; both are stored and read from there.
    embedder = Embedder()
    cut = _kept(embedder.counted(_stride_chunks(spark, d).select("chunk_id", "text")), "chunks")
    embedder.fit(cut)
    index = _kept(embedder.embed(cut).select("chunk_id", "embedding"), "passages")
    turns = inputs.table(spark, d, "conversations").where(F.col("role") == "user")
    asked = turns.select(F.format_string("%d_%d", F.col("conv_id"), F.col("turn")).alias("query_id"), "text")
    found = nearest(embedder.embed(asked), index)
    return found.select("query_id", _long("rank"), "chunk_id", F.round("distance", 6).alias("distance"))


@query
def idf_by_versions(spark, d):
    # All documents come in three versions; a fourth takes some of them away again.
    folder = shared_folder(spark, "frequencies")
    docs = inputs.documents(spark, d)
    for version in range(3):
        frequencies.write_version(folder, version, docs.where(F.col("doc_id") % 3 == version))
    frequencies.write_version(folder, 3, docs.limit(0), removed=docs.where("doc_id % 7 = 0"))
    found = frequencies.weights(frequencies.frequencies(spark, folder))
    return found.select(_long("slot"), "passages", F.round("idf", 9).alias("idf"))


@query
def policy_files(spark, d):
    # Texts laid down as files and read back whole, a file a row; their lines as policy lines are told from headings.
    folder = shared_folder(spark, "policy-texts")
    inputs.documents(spark, d).select(F.coalesce("text", F.lit("")).alias("text")).write.text(folder)
    lines = policy.policy_text(spark, folder).select(F.explode(chunk.kept_lines(F.col("text"))).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("times"))


@query
def policy_retrieval(spark, d):
    corpus, embedder = corpora.build_corpus(corpora.policy_documents(spark))
    corpus = _kept(corpus.select("chunk_id", "text", "embedding"), "policy")
    a = Applicants(inputs.raw_applicants(spark, d))
    asked = a.df.select("application_id", retrieve.retrieval_query(
        a.text("employment_type"), a.text("age"), a.text("credit_score")).alias("question"))
    # The policy is a few pages whatever the number of applications; a larger corpus is refused here.
    found = retrieve.retrieve(asked, "question", retrieve.VECTORS, corpus, embedder, "application_id", way="broadcast")
    return found.select("application_id", "question", "retrieved.policy",
                        F.size("retrieved.documents").cast("bigint").alias("documents"), "retrieved.confidence")


@query
def retrieval_backends(spark, d):
    # The same questions to every backend that needs no corpus, and to an index without distances.
    corpus, embedder = corpora.build_corpus(corpora.policy_documents(spark))
    corpus = _kept(corpus.select("chunk_id", "text", "embedding"), "policy")
    rows = inputs.raw_applicants(spark, d)
    asked = rows.select("application_id", retrieve.retrieval_query(
        F.col("employment_type"), F.col("age"), F.col("credit_score")).alias("question"))
    by = lambda backend, **more: retrieve.retrieve(asked, "question", backend, **more).select(
        F.lit(backend).alias("backend"), "application_id", "retrieved.policy", "retrieved.confidence")
    index = by(retrieve.INDEX, corpus=corpus, embedder=embedder, spread_by="application_id", way="broadcast")
    return by(retrieve.DISABLED).unionByName(by(retrieve.KEYWORD)).unionByName(index)


# --- reports and prompts -----------------------------------------------------

def _with_policy(evaluated):
    a = Applicants(evaluated)
    asked = evaluated.withColumn("question", retrieve.retrieval_query(a.text("employment_type"), a.text("age"), a.text("credit_score")))
    return retrieve.retrieve(asked, "question")


@query
def report_short(spark, d):
    rows = _with_policy(decide.evaluate(inputs.applicants(spark, d)))
    return rows.select("application_id", report.short_report(F.col("retrieved.policy")).alias("report"))


@query
def report_full(spark, d):
    rows = report.with_full_report(decide.evaluate(inputs.applicants(spark, d), strict=True))
    return rows.select("application_id", "report")


@query
def prompt_table(spark, d):
    rows = _with_policy(decide.evaluate(inputs.applicants(spark, d)))
    return rows.select("application_id", report.explanation_prompt(F.col("retrieved.policy")).alias("prompt"))


# --- assessment, audit, figures ----------------------------------------------

@query
def assess_batch(spark, d):
    rows = assessing.responses(assessing.assess(inputs.raw_applicants(spark, d)))
    return rows.select("application_id", "decision", "confidence", _listed("evaluation_factors"), "reasoning",
                       _listed("documents_required"), "disclaimer", "guardrail_status")


@query
def audit_log(spark, d):
    rows = assessing.audit_rows(assessing.assess(inputs.raw_applicants(spark, d)), MODEL)
    # Without the time of the run.
    return rows.select("application_id", "session_id", "customer_input", "decision", "guardrail_status",
                       "retrieved_documents", "model_name")


@query
def audit_latest(spark, d):
    # Several events per session: the latest one replaces those before.
    log = inputs.audit_rows(spark, d)
    return audit.latest(log, key="session_id").select("session_id", "application_id", "timestamp", "decision", "latency")


@query
def audit_upsert(spark, d):
    # Two batches on one key, merged into a stored table; the first one comes a second time, too late to change anything.
    log = inputs.audit_rows(spark, d)
    folder = shared_folder(spark, "audit-by-key")
    batches = {name: log.where(F.col("application_id").cast("bigint") % 2 == odd) for name, odd in (("first", 0), ("second", 1))}
    for name in ("first", "second", "first"):
        keyed.upsert(batches[name], folder, name, key="session_id", buckets=16)
    return keyed.read(spark, folder).select("session_id", "application_id", "timestamp", "decision", "latency")


def _days(spark, d):
    """The log by day in two batches, counted after each."""
    log, counters = shared_folder(spark, "log-by-day"), shared_folder(spark, "day-counters")
    rows = inputs.audit_rows(spark, d)
    for odd in (0, 1):
        kpi_days.append_by_day(rows.where(F.col("application_id").cast("bigint") % 2 == odd), log, f"batch-{odd}")
        kpi_days.refresh(spark, log, counters)
    return log, counters


@query
def kpi_from_days(spark, d):
    return kpi_days.days_summary(spark, _days(spark, d)[1])


@query
def kpi_by_day(spark, d):
    days = kpi_days.by_day(spark, _days(spark, d)[1])
    return days.withColumn("latency_sum", F.round("latency_sum", 6))


@query
def recent_from_days(spark, d):
    return kpi_days.recent_from_days(spark, *_days(spark, d))


@query
def kpi_summary(spark, d):
    return kpi.kpi_summary(inputs.audit_rows(spark, d))


@query
def decision_distribution(spark, d):
    return kpi.decision_distribution(inputs.audit_rows(spark, d)).select(_long("position"), "name", "count")


@query
def recent_transactions(spark, d):
    return kpi.recent_transactions(inputs.audit_rows(spark, d))


# --- conversations -----------------------------------------------------------

@query
def chat_history(spark, d):
    return history.chat_history(inputs.table(spark, d, "conversations"))


@query
def chat_fallback(spark, d):
    turns = inputs.turns_with(spark, d, inputs.PLANTED_QUESTIONS, step=9).where(F.col("role") == "user")
    asked = turns.select(
        F.format_string("%d_%d", F.col("conv_id"), F.col("turn")).alias("question_id"),
        (F.col("conv_id") * 13 + F.col("turn")).alias("application_id"), F.col("text").alias("question"),
    )
    answers = chat.answer_questions(asked, inputs.applicants(spark, d), "application_id")
    return answers.select("question_id", "application_id", "eligibility", "response")


@query
def followup_prompt_table(spark, d):
    turns = inputs.table(spark, d, "conversations").withColumn("application_id", F.col("conv_id").cast("string"))
    assessed = assessing.assess(inputs.raw_applicants(spark, d))
    return followup_prompts(turns, assessed, "application_id")


@query
def json_tool(spark, d):
    rows = evaluate_json(inputs.payload_json(spark, d))
    shape = ("error string, eligibility string, score bigint, key_factors struct<age: double>, "
             "estimated_terms struct<risk_category: string>, required_income_for_eligibility double, "
             "reasons array<string>, scoring_breakdown struct<Income: bigint>")
    read = rows.select("request_id", "result", F.from_json("result", shape).alias("r"))
    return read.select(
        "request_id", "result", "r.error", "r.eligibility", "r.score", "r.key_factors.age", "r.estimated_terms.risk_category",
        F.col("r.required_income_for_eligibility").alias("needed"), F.get("r.reasons", F.lit(0)).alias("first_reason"),
        F.col("r.scoring_breakdown.Income").alias("income_points"),
    )


# --- streams -----------------------------------------------------------------

def _stream_of(spark, d, name):
    # A table is one file or a folder of files. As a pattern, its path is read as a stream either way.
    schema = inputs.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query
def kpi_refresh_stream(spark, d):
    return kpi_stream.refresh_kpis(spark, inputs.audit_from_events(_stream_of(spark, d, "events")))


@query
def kpi_latest_stream(spark, d):
    # An application is a session here, so that later rows of one replace earlier ones.
    rows = inputs.audit_from_events(_stream_of(spark, d, "events")).drop("application_id", "customer_input")
    return kpi_stream.refresh_latest_kpis(spark, rows, key="session_id")


@query
def chunk_sync_stream(spark, d):
    # Each passage arrives; then a third is rewritten, a stale change comes late, and a seventh is taken out.
    cut = chunk.explode_chunks(_stream_of(spark, d, "documents"), "doc_id", chunk.fixed_stride(F.col("text")))
    changes = _chunk_ids(cut).select("chunk_id", "doc_id", F.explode(F.expr("""
        filter(array(named_struct('at', 1, 'text', text, 'gone', false),
                     if(doc_id % 3 = 0, named_struct('at', 3, 'text', concat('! ', text), 'gone', false), NULL),
                     if(doc_id % 3 = 0, named_struct('at', 2, 'text', concat('~ ', text), 'gone', false), NULL),
                     if(doc_id % 7 = 0, named_struct('at', 4, 'text', cast(NULL AS string), 'gone', true), NULL)),
               x -> x IS NOT NULL)""")).alias("c")).select("chunk_id", "c.*")
    index = shared_folder(spark, "chunk-index")
    chunk_sync.sync_chunks(changes, index, shared_folder(spark, "chunk-sync"), F.col("at"), F.col("gone"))
    return chunk_sync.current_index(spark, index).select("chunk_id", "text")


@query
def new_chunks(spark, d):
    cut = _stride_chunks(spark, d)
    return chunk_sync.new_chunks(cut.select("chunk_id", "text"), cut.where("doc_id % 2 = 0"))


# --- files and tables --------------------------------------------------------

def _fresh(name):
    return f"{name}_{uuid.uuid4().hex}"


@query
def customer_files(spark, d):
    # The directory written as files with a header, then read with its schema.
    rows = inputs.applicants(spark, d).select(
        "name", "age", "monthly_income", "employment_type", "credit_score", "existing_liabilities", "loan_amount_requested")
    folder = shared_folder(spark, "customers")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(folder)
    return customers.read_customers(spark, folder)


@query
def verdict_by_rule_file(spark, d):
    # Rules read from a file: applicants from 30 on, and a credit score of 650.
    document = copy.deepcopy(DEFAULT_RULES_DOCUMENT)
    document["thresholds"] |= {"min_age": 30, "minimum_credit_score": 650}
    folder = shared_folder(spark, "rules")
    spark.range(1).select(F.lit(json.dumps(document)).alias("value")).write.text(folder)
    loaded = rules.load_rules(spark, f"{folder}-absent", folder)
    rows = decide.score_applicants(inputs.applicants(spark, d), loaded)
    return rows.select("application_id", "stage", "eligibility", _long("score"))


@query
def audit_append_and_scan(spark, d):
    # Two batches go into the log; it is read whole.
    log = _fresh("audit")
    raw = inputs.raw_applicants(spark, d)
    for odd in (0, 1):
        batch = raw.where(F.col("application_id").cast("bigint") % 2 == odd)
        assessing.record(assessing.assess(batch), MODEL, log, latency=0.5)
    return audit.read(spark, log).select("application_id", "session_id", "customer_input", "decision", "guardrail_status",
                                         "latency", "retrieved_documents", "model_name")


@query
def table_overwrite(spark, d):
    # A second write replaces rows and columns of the first.
    tables.ensure_namespace(spark, "lendlane_scratch")
    name = f"lendlane_scratch.{_fresh('t')}"
    tables.overwrite(inputs.table(spark, d, "orders").select("o_orderkey"), name)
    tables.overwrite(inputs.table(spark, d, "customer").select("c_custkey", "c_name"), name)
    return spark.table(name)


@query
def policy_line_table(spark, d):
    # Created from its source; a second call leaves it; a source without lines gets the built-in ones.
    name, empty = _fresh("lines"), _fresh("lines")
    pages = inputs.documents(spark, d).withColumnRenamed("doc_id", "page")
    corpora.ensure_policy_lines(spark, name, pages)
    corpora.ensure_policy_lines(spark, name, pages.withColumn("text", F.lit("never written, as the table is there")))
    corpora.ensure_policy_lines(spark, empty, pages.withColumn("text", F.lit("short")))
    return spark.table(name).withColumn("origin", F.lit("pages")).unionByName(
        spark.table(empty).withColumn("origin", F.lit("built in")))


# --- switches and ids --------------------------------------------------------

@query
def assess_without_gates(spark, d):
    gates = Gates(guardrails=False, retrieval=False, audit=False)
    rows = assessing.responses(assessing.assess(inputs.raw_applicants(spark, d), gates=gates))
    return rows.select("application_id", "decision", "confidence", "reasoning", "guardrail_status")


@query
def application_ids(spark, d):
    rows = inputs.raw_applicants(spark, d).withColumnRenamed("application_id", "order_id")
    some = rows.withColumn("session_id", F.when(F.col("order_id").cast("bigint") % 7 != 0, F.col("session_id")))
    return assessing.with_identity(some, "order_id", "name", "age").select("order_id", "application_id", "session_id")
