"""Reports and prompts as text columns.

All functions read the columns that `decide.evaluate` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions import finance
from lendlane.functions.text import bullets, grouped, grouped_number, plain_number, quoted, quoted_list
from lendlane.operators.guards import DISCLAIMER, REPORT_MARKER

# What a verdict and a risk category mean.
VERDICT_MEANING = {
    "Eligible": "Meets the bank's baseline lending criteria and is Eligible for Consideration.",
    "Conditionally Eligible": "Meets partial criteria. Additional verification is required.",
    "Not Eligible": "Does not currently meet the bank's minimum lending criteria.",
}
RISK_MEANING = {
    "Very Low": "Bank exposure is minimal. Strong candidate.",
    "Low": "Bank exposure is low. Profile is generally stable.",
    "Moderate": "Some risk factors present. Further review advised.",
    "High": "Significant risk factors identified. Caution recommended.",
    "Very High": "Multiple critical thresholds failed. Not recommended.",
    "Invalid Input": "Data provided was invalid or could not be assessed.",
}
UNKNOWN_RISK = "Risk level is undetermined."
# Texts that stand for an empty list.
NO_VIOLATIONS = "  • Profile complies with baseline standards."
NO_FLAGS = "   - No specific flags raised."


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _lookup(values: dict, key: Column, absent: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], F.lit(absent))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def status_label(points: Column, threshold: int = 1) -> Column:
    return F.when(F.coalesce(points, F.lit(0)) >= threshold, "Passed").otherwise("Review Required")


def evaluation_factors() -> Column:
    """Four "label: value" texts; numbers show a fraction only where they have one."""
    k = F.col("key_factors")
    shown = lambda n: F.coalesce(plain_number(k.getField(n)), F.lit("None"))
    return F.array(
        _join("Income: ", shown("monthly_income")),
        _join("Credit Score: ", shown("credit_score")),
        _join("Existing Liabilities: ", shown("existing_liabilities")),
        _join("Employment: ", k.getField("employment_type")),
    )


def short_report(policy: Column) -> Column:
    """The four-section report."""
    # Its wording.
    k = F.col("key_factors")
    return _join(
        "1. Underwriting Decision Summary\n  Verdict: ", F.col("eligibility"),
        "\n  Credit Score Assessment: ", F.col("score").cast("string"),
        "/100\n  Process Mode: Local Rule Engine Policy Evaluation\n\n"
        "2. Underwriter Assessment\n  Applicant Name: ", k.getField("name"),
        "\n  Monthly Verified Income: INR ", grouped(_or_zero(k.getField("monthly_income"))),
        "\n  Credit Bureau Score: ", plain_number(_or_zero(k.getField("credit_score"))),
        "\n  Requested Capital: INR ", grouped(_or_zero(k.getField("loan_amount_requested"))),
        "\n\n3. Key Policy Rule Violations/Flags\n", bullets(F.col("reasons"), "  • ", NO_VIOLATIONS),
        "\n\n4. Supporting Policy Document Findings\n  ", policy, "\n",
    )


def with_full_report(df: DataFrame, output: str = "report") -> DataFrame:
    """Add the five-section report. Its texts read unscored parts as not passed, as the report always did."""
    k, b = F.col("key_factors"), F.col("scoring_breakdown")
    number = lambda n: _or_zero(k.getField(n))
    points = lambda n: F.coalesce(b.getField(n), F.lit(0))
    read = df.withColumns({
        "r_income": number("monthly_income"), "r_credit": number("credit_score"),
        "r_requested": number("loan_amount_requested"), "r_employment": k.getField("employment_type"),
        "r_dti": finance.debt_percent(number("existing_liabilities"), number("monthly_income")),
        "r_risk": F.coalesce(F.col("estimated_terms").getField("risk_category"), F.lit("High")),
        "r_p_income": points("income"), "r_p_credit": points("credit_score"), "r_p_debt": points("liabilities"),
        "r_p_employment": points("employment"), "r_p_request": points("loan_request"),
    }).withColumns({
        "r_income_text": grouped_number(F.col("r_income")), "r_credit_text": plain_number(F.col("r_credit")),
        # One decimal place always, as a float shows it; a whole 0 where there is no income.
        "r_dti_text": F.when(F.col("r_income") != 0, F.format_string("%.1f", F.col("r_dti"))).otherwise("0"),
    })
    income, credit, dti = F.col("r_income_text"), F.col("r_credit_text"), F.col("r_dti_text")
    p_income, p_credit, p_debt = F.col("r_p_income"), F.col("r_p_credit"), F.col("r_p_debt")
    employment, p_request, risk = F.col("r_employment"), F.col("r_p_request"), F.col("r_risk")
    eligible = F.col("eligibility") == finance.ELIGIBLE

    result = _join(
        REPORT_MARKER, "\n   - **Status: ", F.col("eligibility"), "** — ",
        _lookup(VERDICT_MEANING, F.col("eligibility"), ""),
        "\n   - **Rule Engine Score:** ", F.col("score").cast("string"), "/100",
        "\n   - **Risk Category:** ", risk, " — ", _lookup(RISK_MEANING, risk, UNKNOWN_RISK),
    )
    factors = _join(
        "### 2. Key Evaluation Factors",
        "\n   - **Monthly Income (Rs.", income, "):** ", status_label(p_income), " — ",
        F.when(p_income >= 2, "Meets preferred baseline (Rs.50,000+).")
        .when(p_income == 1, "Below preferred threshold of Rs.50,000.")
        .otherwise("Below minimum baseline of Rs.30,000."),
        "\n   - **Credit Score (", credit, "):** ", status_label(p_credit), " — ",
        F.when(p_credit == 2, "Excellent (750+).").when(p_credit == 1, "Acceptable, below 750 threshold.")
        .otherwise("Below minimum threshold of 600."),
        "\n   - **Employment (", employment, "):** ", status_label(F.col("r_p_employment"), 0), " — ",
        F.when(employment == "Salaried", "Salaried — most preferred.")
        .when(employment.isin("Self-employed", "Business"), "Self-employed/Business — acceptable.")
        .otherwise("Student/Unemployed — high risk."),
        "\n   - **Liabilities (DTI: ", dti, "%):** ", status_label(p_debt), " — ",
        F.when(p_debt == 2, "Within acceptable limits.").when(p_debt == 1, "Moderate — may affect repayment.")
        .otherwise(_join("DTI ", dti, "% exceeds 40% cap.")),
        "\n   - **Loan Amount (Rs.", grouped_number(F.col("r_requested")), "):** ", status_label(p_request), " — ",
        F.when(p_request >= 1, "Within income multiple range.")
        .otherwise(_join("High relative to income of Rs.", income, ".")),
    )
    needed = F.col("required_income_for_eligibility")
    upgrade = F.when(
        ~eligible & (needed > 0) & (needed > F.col("r_income")),
        _join("\n   - If your income increases to Rs.", grouped(needed), ", you become eligible."),
    ).otherwise("")
    reasoning = _join(
        "### 3. Reasoning Summary\n   - **Decision Basis:** ",
        F.when(eligible, "All critical thresholds were met.").otherwise("One or more critical thresholds were not met."),
        "\n   - **Income:** Rs.", income, " ", F.when(p_income >= 1, "meets").otherwise("does not meet"),
        " the minimum lending threshold.",
        "\n   - **Credit:** Score of ", credit, " ",
        F.when(F.col("r_credit") >= 750, "is strong (750+).").when(F.col("r_credit") >= 600, "is acceptable.")
        .otherwise("is below the 600 minimum."),
        "\n   - **DTI:** ", dti, "% ",
        F.when(F.col("r_dti") <= 40, "is within limits.").otherwise("exceeds the 40% cap."),
        "\n   - **Flags:**\n", bullets(F.col("reasons"), "   - ", NO_FLAGS), upgrade,
    )
    steps = _join("### 4. Suggested Next Steps\n", bullets(F.col("next_steps"), "   - "))
    closing = _join("### 5. Disclaimer\n   - ", DISCLAIMER)
    report = F.concat_ws("\n\n", result, factors, reasoning, steps, closing)
    return read.withColumn(output, report).select(*df.columns, output)


def factors_text() -> Column:
    """The key factors as they appear in a prompt."""
    # The names of the factors.
    k = F.col("key_factors")
    number = lambda n: F.coalesce(plain_number(k.getField(n)), F.lit("None"))
    return _join(
        "{'name': ", quoted(k.getField("name")), ", 'age': ", number("age"),
        ", 'monthly_income': ", number("monthly_income"), ", 'employment_type': ", quoted(k.getField("employment_type")),
        ", 'credit_score': ", number("credit_score"), ", 'existing_liabilities': ", number("existing_liabilities"),
        ", 'loan_amount_requested': ", number("loan_amount_requested"),
        ", 'loan_purpose': ", quoted(k.getField("loan_purpose")), "}",
    )


def explanation_prompt(policy: Column) -> Column:
    """The prompt an offline model job would be given for an evaluated application."""
    # Its wording.
    k = F.col("key_factors")
    return _join(
        "\n    Evaluate the following application:\n    Customer: ", k.getField("name"),
        "\n    Requested Amount: INR ", grouped(_or_zero(k.getField("loan_amount_requested"))),
        "\n    Verdict: ", F.col("eligibility"), "\n    Score: ", F.col("score").cast("string"), "/100",
        "\n    Rule engine factors: ", factors_text(), "\n    Rule engine flags: ", quoted_list(F.col("reasons")),
        "\n    Policy Context: ", policy, "\n\n    Please write a clean credit underwriter evaluation report.\n    ",
    )
