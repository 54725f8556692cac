"""Job parameters: nine texts per application, read into typed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlane.functions.numbers import safe_float, safe_int
from lendlane.functions.text import strip


def typed_payload(parameters: DataFrame) -> DataFrame:
    """Texts trimmed, numbers read or 0. Other columns are kept."""
    given = set(parameters.columns)
    text = lambda n: strip(F.coalesce(F.col(n), F.lit(""))) if n in given else F.lit("")
    number = lambda n, read: read(F.col(n)) if n in given else read(F.lit(None).cast("string"))
    typed = {
        "name": text("name"), "age": number("age", safe_int), "monthly_income": number("monthly_income", safe_float),
        "employment_type": text("employment_type"), "credit_score": number("credit_score", safe_int),
        "existing_loan": text("existing_loan"), "monthly_loan_payment": number("monthly_loan_payment", safe_float),
        "loan_amount_requested": number("loan_amount_requested", safe_float), "loan_purpose": text("loan_purpose"),
    }
    return parameters.withColumns(typed)


def accepted(payload: DataFrame) -> DataFrame:
    return payload.where(F.col("name") != "")


def rejected(payload: DataFrame) -> DataFrame:
    """Applications without a name: a job of one would fail, a batch sets them aside."""
    return payload.where(F.col("name") == "")
