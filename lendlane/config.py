"""Rule configuration: thresholds and wording that the scoring cascade reads."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# The shipped rule configuration.
DEFAULT_RULES_DOCUMENT = {
    "version": "1.0",
    "currency": "INR",
    "decision_order": ["Not Eligible", "Conditionally Eligible", "Eligible"],
    "thresholds": {
        "min_age": 21,
        "max_age": 60,
        "eligible_min_income_monthly": 50000,
        "conditional_min_income_monthly": 30000,
        "excellent_credit_score": 750,
        "minimum_credit_score": 600,
        "high_liability_ratio": 0.4,
        "conditional_liability_ratio": 0.25,
        "max_loan_to_income_ratio": 20,
    },
    "employment_rules": {
        "salaried_bonus": 1,
        "self_employed_bonus": 0,
        "student_penalty": -2,
        "unemployed_penalty": -5,
    },
    "reasons_map": {
        "age_out_of_range": "Applicant age is outside the accepted lending range.",
        "low_income": "Monthly income is below the minimum baseline.",
        "low_credit": "Credit score is below the acceptable lending threshold.",
        "high_liabilities": "Existing liabilities are high relative to income.",
        "unsupported_employment": "Employment profile is not preferred for this policy.",
        "requested_amount_high": "Requested loan amount is high compared to income.",
        "positive_profile": "Income, credit score, and liabilities are within preferred limits.",
    },
}

# Fixed value: incomes above this are never proposed as "the income you need".
INCOME_CAP = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Thresholds the cascade applies. `employment_rules` and `decision_order`
    are carried in `document` but, as in the decision logic itself, unused."""

    min_age: float
    max_age: float
    full_income: float
    base_income: float
    excellent_credit: float
    minimum_credit: float
    high_debt_ratio: float
    low_debt_ratio: float
    max_loan_multiple: float
    wording: dict = field(hash=False)
    document: dict = field(hash=False, repr=False)

    @staticmethod
    def from_document(document: dict) -> "Rules":
        t = document["thresholds"]
        return Rules(
            min_age=float(t["min_age"]),
            max_age=float(t["max_age"]),
            full_income=float(t["eligible_min_income_monthly"]),
            base_income=float(t["conditional_min_income_monthly"]),
            excellent_credit=float(t["excellent_credit_score"]),
            minimum_credit=float(t["minimum_credit_score"]),
            high_debt_ratio=float(t["high_liability_ratio"]),
            low_debt_ratio=float(t["conditional_liability_ratio"]),
            max_loan_multiple=float(t["max_loan_to_income_ratio"]),
            wording=dict(document["reasons_map"]),
            document=document,
        )

    def as_text(self) -> str:
        """The rules rendered as a document for the policy corpus."""
        return "Loan Eligibility Rules Config:\n" + json.dumps(self.document, indent=2)


DEFAULT_RULES = Rules.from_document(DEFAULT_RULES_DOCUMENT)


@dataclass(frozen=True)
class Gates:
    """Feature switches, resolved on the driver when a plan is put together."""

    guardrails: bool = True
    retrieval: bool = True
    audit: bool = True
