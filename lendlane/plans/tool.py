"""The rule engine behind a JSON interface: a JSON payload in, a JSON result out, for a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.config import DEFAULT_RULES, Rules
from lendlane.functions.text import plain_number
from lendlane.operators.decide import evaluate
from lendlane.schemas import PAYLOAD

# Fixed value: the result for a payload that is not JSON.
BAD_JSON = '{"error": "Invalid JSON. Please pass customer data as a JSON string."}'
# Labels of the parts of a score in the result.
PARTS = {
    "Income": "income", "Credit Score": "credit_score", "Liabilities": "liabilities", "Employment": "employment",
    "Loan Request": "loan_request",
}
_NUMBERS = ("age", "monthly_income", "credit_score", "existing_liabilities", "loan_amount_requested")


def _text(c: Column) -> Column:
    """A text as JSON, `null` included."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _number(c: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.coalesce(plain_number(c), F.lit("null"))


def _object(members: dict[str, Column], indent: str) -> Column:
    lines = [F.concat(F.lit(f'{indent}  "{name}": '), value) for name, value in members.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit(f"\n{indent}}}"))


def _list(items: Column, indent: str) -> Column:
    lines = F.transform(items, lambda i: F.concat(F.lit(indent + "  "), _text(i)))
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit(f"\n{indent}]")))


def result_text() -> Column:
    """An evaluation as indented JSON. Every key factor is there, `null` where it could not be read.

    A payload that failed the sanity step has an empty breakdown; only scored ones have all terms.
    """
    k, b, t = F.col("key_factors"), F.col("scoring_breakdown"), F.col("estimated_terms")
    factors = {n: (_number if n in _NUMBERS else _text)(k[n]) for n in (
        "name", "age", "monthly_income", "employment_type", "credit_score", "existing_liabilities",
        "loan_amount_requested", "loan_purpose")}
    points = {label: b[part].cast("string") for label, part in PARTS.items()}
    all_terms = {n: _text(t[n]) for n in ("estimated_interest_rate", "maximum_tenure", "risk_category", "processing_fee")}
    risk_only = {"risk_category": all_terms["risk_category"]}
    return _object({
        "eligibility": _text(F.col("eligibility")),
        "score": F.col("score").cast("string"),
        "key_factors": _object(factors, "  "),
        "scoring_breakdown": F.when(b["income"].isNull(), "{}").otherwise(_object(points, "  ")),
        "reasons": _list(F.col("reasons"), "  "),
        "next_steps": _list(F.col("next_steps"), "  "),
        "estimated_terms": F.when(t["maximum_tenure"].isNull(), _object(risk_only, "  ")).otherwise(_object(all_terms, "  ")),
        "required_income_for_eligibility": F.col("required_income_for_eligibility").cast("string"),
    }, "")


def evaluate_json(df: DataFrame, payload: str = "customer_data", output: str = "result",
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add the strict evaluation of each payload as JSON text."""
    parsed = df.withColumn("t_payload", F.from_json(F.col(payload), PAYLOAD)).withColumn(
        "t_good", F.expr(f"try_parse_json(`{payload}`)").isNotNull()
    )
    flat = parsed.select(
        *[F.col(c).alias(f"t_in_{c}") for c in df.columns], "t_good", *[F.col(f"t_payload.{f.name}") for f in PAYLOAD.fields]
    )
    scored = evaluate(flat, rules, strict=True)
    as_json = F.when(F.col("t_good"), result_text()).otherwise(F.lit(BAD_JSON))
    return scored.select(*[F.col(f"t_in_{c}").alias(c) for c in df.columns], as_json.alias(output))
