"""Explicit schemas for every table that is read or written."""

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CUSTOMER_FILE = _struct(
    name=_S, age=_L, monthly_income=_L, employment_type=_S, credit_score=_L,
    existing_liabilities=_L, loan_amount_requested=_L,
)

RAW_APPLICANTS = _struct(
    application_id=_S, session_id=_S, name=_S, age=_S, monthly_income=_S, employment_type=_S,
    credit_score=_S, existing_liabilities=_S, existing_loan=_S, monthly_loan_payment=_S,
    loan_amount_requested=_S, loan_purpose=_S, user_message=_S,
)

RULES_FILE = _struct(
    version=_S, currency=_S, decision_order=T.ArrayType(_S),
    thresholds=_struct(
        min_age=_D, max_age=_D, eligible_min_income_monthly=_D, conditional_min_income_monthly=_D,
        excellent_credit_score=_D, minimum_credit_score=_D, high_liability_ratio=_D,
        conditional_liability_ratio=_D, max_loan_to_income_ratio=_D,
    ),
    employment_rules=_struct(
        salaried_bonus=_I, self_employed_bonus=_I, student_penalty=_I, unemployed_penalty=_I,
    ),
    reasons_map=T.MapType(_S, _S),
)

# Applicant fields a JSON payload may carry; numbers arrive as text or as numbers.
PAYLOAD = _struct(
    name=_S, age=_S, monthly_income=_S, employment_type=_S, credit_score=_S, existing_liabilities=_S,
    existing_loan=_S, monthly_loan_payment=_S, loan_amount_requested=_S, loan_purpose=_S,
)

AUDIT_LOG = T.StructType([
    T.StructField("application_id", _S, False),
    T.StructField("session_id", _S),
    T.StructField("timestamp", _S),
    T.StructField("customer_input", _S),
    T.StructField("decision", _S),
    T.StructField("guardrail_status", _S),
    T.StructField("latency", _D),
    T.StructField("retrieved_documents", _S),
    T.StructField("model_name", _S),
])

POLICY_CHUNKS = T.StructType([
    T.StructField("chunk_id", _S, False),
    T.StructField("text", _S),
])

EMBEDDED_CHUNKS = T.StructType([
    T.StructField("chunk_id", _S, False),
    T.StructField("text", _S),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
