"""The whole assessment of a table of applications, and its audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.config import DEFAULT_RULES, Gates, Rules
from lendlane.functions.text import quoted_list
from lendlane.operators import guards, retrieve
from lendlane.operators.applicants import FIELD_ORDER, Applicants
from lendlane.operators.decide import confidence, evaluate, required_documents
from lendlane.operators.report import evaluation_factors, short_report
from lendlane.operators.validate import validate_required, validation_reason
from lendlane.sources import audit

# What an outcome is logged as.
LOGGED_BLOCKED = ("Blocked / Not Eligible", "Blocked (Input Guardrail)")
LOGGED_INVALID = ("Not Eligible", "Passed (Input Guardrail) | Failed (Validation)")
LOGGED_SCORED = "Compliant"
NO_MODEL = "N/A"


def with_identity(df: DataFrame, *business_key: str) -> DataFrame:
    """Add `application_id` (and `session_id` where missing), derived from the business key.

    Ids derived from the data stay the same when a lost task is run again.
    """
    digest = F.sha2(F.to_json(F.struct(*business_key), {"ignoreNullFields": "false"}), 256)
    out = df if "application_id" in df.columns else df.withColumn("application_id", digest)
    given = F.col("session_id") if "session_id" in out.columns else F.lit(None).cast("string")
    fallback = F.sha2(F.concat(F.lit("session:"), F.col("application_id").cast("string")), 256)
    return out.withColumn("session_id", F.coalesce(F.when(given != "", given), fallback))


def assess(applications: DataFrame, rules: Rules = DEFAULT_RULES, gates: Gates = Gates(), corpus: DataFrame | None = None,
           embedder=None, fixed_confidence: bool = False, **nearest_options) -> DataFrame:
    """Guard, validate, score, retrieve, report and clean every application.

    Adds: outcome (blocked, invalid or scored), decision, confidence,
    evaluation_factors, reasoning, documents_required, disclaimer,
    guardrail_status, sanitized, retrieved, and the evaluation itself.
    Passages come from the keyword table, or from `corpus` when one is given.
    With keywords the whole assessment is one narrow stage. Applications without
    ids get them from what they say (`with_identity`); equal ones share an id.
    """
    if "application_id" not in applications.columns:
        stated = [n for n in (*FIELD_ORDER, "user_message") if n in applications.columns]
        applications = with_identity(applications, *stated)
    guarded = guards.check_applicants(applications, enabled=gates.guardrails)
    checked = validate_required(guarded)
    outcome = F.when(F.col("blocked"), "blocked").when(~F.col("valid"), "invalid").otherwise("scored")
    a = Applicants(applications)
    query = retrieve.retrieval_query(a.text("employment_type"), a.text("age"), a.text("credit_score"))
    scored = evaluate(checked.withColumn("outcome", outcome), rules).withColumn(
        "retrieval_query", F.when(F.col("outcome") == "scored", query)
    )
    backend = retrieve.KEYWORD if corpus is None else retrieve.INDEX if fixed_confidence else retrieve.VECTORS
    if not gates.retrieval:
        backend = retrieve.DISABLED
    found = retrieve.retrieve(scored, "retrieval_query", backend, corpus, embedder, "application_id", **nearest_options)
    is_scored = F.col("outcome") == "scored"
    none = F.array().cast("array<string>")
    reasoning = (
        F.when(F.col("outcome") == "blocked", F.concat(F.lit("Application suspended: "), F.col("reason")))
        .when(F.col("outcome") == "invalid", validation_reason(F.col("missing_fields"), F.col("errors")))
        .otherwise(short_report(F.col("retrieved").getField("policy")))
    )
    composed = found.withColumns({
        "decision": F.when(is_scored, F.col("eligibility")).otherwise("Not Eligible"),
        "confidence": F.when(is_scored, confidence(F.col("eligibility"), F.col("valid"), F.size("errors"))).otherwise("LOW"),
        "evaluation_factors": F.when(is_scored, evaluation_factors()).otherwise(none),
        "draft": reasoning,
        "documents_required": F.when(is_scored, required_documents(F.col("eligibility"))).otherwise(none),
        "disclaimer": F.lit(guards.DISCLAIMER),
    })
    # Only reports of scored applications are cleaned; refusals are fixed texts.
    draft, reports = F.col("draft"), F.when(is_scored, F.col("draft"))
    cleaned = guards.with_softened(composed, reports, "reasoning") if gates.guardrails else composed.withColumn("reasoning", draft)
    return cleaned.withColumn("reasoning", F.coalesce("reasoning", "draft")).withColumns({
        "sanitized": F.col("reasoning") != draft,
        "guardrail_status": F.when(F.col("outcome") == "blocked", LOGGED_BLOCKED[1])
        .when(F.col("outcome") == "invalid", LOGGED_INVALID[1]).otherwise(LOGGED_SCORED),
    }).drop("draft")


def customer_input(applications: DataFrame) -> Column:
    """The application as it came in, as JSON, absent values included."""
    fields = [n for n in FIELD_ORDER if n in applications.columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def audit_rows(assessed: DataFrame, model_name: str, latency: float | None = None) -> DataFrame:
    """One audit row per assessment; all outcomes share the schema, so one pass writes them all.

    A batch has no latency per row: the caller may give the batch's own.
    """
    is_scored = F.col("outcome") == "scored"
    documents = F.when(is_scored, F.col("retrieved").getField("documents")).otherwise(F.array().cast("array<string>"))
    return assessed.select(
        F.col("application_id").cast("string").alias("application_id"),
        (F.col("session_id") if "session_id" in assessed.columns else F.lit(None)).cast("string").alias("session_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        customer_input(assessed).alias("customer_input"),
        F.when(F.col("outcome") == "blocked", LOGGED_BLOCKED[0]).otherwise(F.col("decision")).alias("decision"),
        "guardrail_status",
        F.lit(latency).cast("double").alias("latency"),
        F.to_json(documents).alias("retrieved_documents"),
        F.when(is_scored, model_name).otherwise(NO_MODEL).alias("model_name"),
    )


def record(assessed: DataFrame, model_name: str, table: str = audit.AUDIT_TABLE, latency: float | None = None,
           gates: Gates = Gates()) -> bool:
    """Append the audit rows of a batch, if auditing is on; tells whether anything was written."""
    return gates.audit and audit.append(audit_rows(assessed, model_name, latency), table)


def responses(assessed: DataFrame) -> DataFrame:
    """The six parts of an answer to an applicant, plus what the cleaning did."""
    return assessed.select(
        "application_id", "decision", "confidence", "evaluation_factors", "reasoning", "documents_required",
        "disclaimer", F.when(F.col("sanitized"), "Sanitized").alias("guardrail_status"),
    )


def factors_for_prompt() -> Column:
    return quoted_list(F.col("evaluation_factors"))
