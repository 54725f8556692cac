"""Answers to follow-up questions without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.config import DEFAULT_RULES, Rules
from lendlane.functions import finance
from lendlane.functions.text import bullets, grouped, present, whole
from lendlane.operators.applicants import Applicants
from lendlane.operators.decide import evaluate
from lendlane.operators.guards import chat_guard, clean_chat
from lendlane.operators.skew import join_unique

# Words that tell what is asked, in the order they are tried.
IMPROVE_WORDS = ["improve", "how to", "what to do", "increase", "better", "fix", "rectify", "help"]
WHY_WORDS = ["why", "reason", "rejected", "decline", "failed", "not eligible"]
# The credit score and the loan multiple the advice refers to.
ADVISED_CREDIT = 750
ADVISED_MULTIPLE = 20
# Wording.
ALREADY_ELIGIBLE = (
    "Your application is currently rated as Eligible. You do not need to make any specific profile improvements. "
    "Please proceed with submitting your standard KYC documents (PAN/Aadhaar, address proof, bank statements, and "
    "salary slips) for formal underwriting review."
)
ADVICE_INTRO = (
    "Based on our policy rules, here are key actionable steps you can take to improve your loan eligibility:\n\n"
)
ADVICE_INCOME = (
    "  • Increase Monthly Income: Your income is below the optimal threshold for the requested loan. Increasing your "
    "monthly income to approximately INR ",
    " or adding a co-applicant with regular income will significantly improve your status.",
)
ADVICE_CREDIT = (
    "  • Boost Credit Score: Your current credit score is below our premium benchmark (750). To improve this, ensure "
    "all utility bills, credit card balances, and existing EMI payments are settled on time, and limit new credit "
    "inquiries."
)
ADVICE_DEBT = (
    "  • Reduce Outstanding Debt: High existing monthly EMI obligations increase your debt-to-income ratio. Paying "
    "off smaller outstanding loans before applying will lower your liabilities and boost borrowing eligibility."
)
ADVICE_AMOUNT = (
    "  • Reduce Requested Amount: The requested loan amount is high relative to your income. Consider lowering your "
    "request to around INR ",
    " to fit within the standard multiplier guidelines.",
)
ADVICE_OTHER = (
    "  • Provide Co-applicant Details: Adding a co-applicant (spouse or parent) with a stable income and a strong "
    "credit history can help mitigate high-risk indicators."
)
NO_APPLICATION = "I am currently unable to access the policy engine to analyze your profile. Please try again later."
WHY_PARTS = (
    "Your preliminary assessment status is ",
    " due to the following policy criteria:\n\n",
    "\n\nOur system requires applicants to meet specific thresholds for age, income, debt-to-income ratio, and credit "
    "history to ensure institutional compliance.",
)
WHY_UNKNOWN = (
    "Your application does not currently meet our baseline eligibility criteria. This is typically due to a "
    "combination of credit score, debt-to-income ratio, or income requirements."
)
DEFAULT_PARTS = (
    "As your virtual assistant, I can confirm your current preliminary assessment status is ",
    " with an eligibility score of ",
    "/100. For specific tips on how to improve this assessment, please ask 'What should I improve?'",
)


def _mentions(question: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(question, F.lit(w)) for w in words])


def with_advice(evaluated: DataFrame) -> DataFrame:
    """Add `advice`: the steps that would help an application, in order."""
    a = Applicants(evaluated)
    credit = whole(F.coalesce(a.number("credit_score"), F.lit(0.0)))
    requested = whole(F.coalesce(a.number("loan_amount_requested"), F.lit(0.0)))
    income = whole(F.coalesce(a.number("monthly_income"), F.lit(0.0)))
    # An income of 0 (or none) counts as 1 here.
    income = F.when(income == 0, F.lit(1.0)).otherwise(income)
    payment = a.text("monthly_loan_payment")
    pays = payment.isNotNull() & (payment != "") & ~a.is_zero("monthly_loan_payment")
    needed = F.col("required_income_for_eligibility")
    steps = present(
        F.when(needed > 0, F.concat(F.lit(ADVICE_INCOME[0]), grouped(needed), F.lit(ADVICE_INCOME[1]))),
        F.when(credit < ADVISED_CREDIT, ADVICE_CREDIT),
        F.when((a.text("existing_loan") == "Yes") | pays, ADVICE_DEBT),
        F.when((income > 0) & (requested / income > ADVISED_MULTIPLE),
               F.concat(F.lit(ADVICE_AMOUNT[0]), grouped(income * ADVISED_MULTIPLE), F.lit(ADVICE_AMOUNT[1]))),
    )
    return evaluated.withColumn("advice", F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(ADVICE_OTHER))))


def fallback_answer(question: Column) -> Column:
    """The answer by what the question mentions: improvement, reasons, or neither."""
    q = F.lower(question)
    improve = F.when(F.col("eligibility") == finance.ELIGIBLE, ALREADY_ELIGIBLE).otherwise(
        F.concat(F.lit(ADVICE_INTRO), F.array_join("advice", "\n\n"))
    )
    why = F.when(
        F.size("reasons") > 0,
        F.concat(F.lit(WHY_PARTS[0]), F.col("eligibility"), F.lit(WHY_PARTS[1]),
                 bullets(F.col("reasons"), "  • "), F.lit(WHY_PARTS[2])),
    ).otherwise(WHY_UNKNOWN)
    default = F.concat(
        F.lit(DEFAULT_PARTS[0]), F.col("eligibility"), F.lit(DEFAULT_PARTS[1]), F.col("score").cast("string"),
        F.lit(DEFAULT_PARTS[2]),
    )
    return F.when(_mentions(q, IMPROVE_WORDS), improve).when(_mentions(q, WHY_WORDS), why).otherwise(default)


def answer_questions(questions: DataFrame, applicants: DataFrame, key: str, question: str = "question",
                     rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Answer each question about an application: refusal if blocked, else the routed answer, cleaned.

    A question whose application is not there is told so; none is left out.

    The application is joined first and evaluated after, so only applications
    somebody asked about are evaluated.
    """
    asked = join_unique(questions, applicants.withColumn("is_known", F.lit(True)), key)
    answered = with_advice(evaluate(asked, rules)).withColumn("refusal", chat_guard(F.col(question)))
    said = F.when(F.col("is_known"), fallback_answer(F.col(question))).otherwise(F.lit(NO_APPLICATION))
    cleaned = clean_chat(answered, F.when(F.col("refusal").isNull(), said))
    return cleaned.withColumn("response", F.coalesce("refusal", "response")).withColumn(
        "eligibility", F.when(F.col("is_known"), F.col("eligibility"))).drop("refusal", "is_known")


def followup_prompt(customer_json: Column, decision: Column, confidence: Column, factors: Column,
                    history: Column, question: Column) -> tuple[Column, Column]:
    """System and user prompt for a follow-up question."""
    # The wording of both.
    system = F.concat(
        F.lit("\n        You are an Intelligent Loan Assistant. Answer customer follow-up questions based on their "
              "assessment.\n        Customer Data: "), customer_json,
        F.lit("\n        Verdict: "), decision, F.lit("\n        Confidence: "), confidence,
        F.lit("\n        Orchestration factors: "), factors,
        F.lit(
            "\n\n        Rules:"
            "\n        - Never guarantee loan approvals. Use terms like \"subject to verification\" or \"preliminary assessment\"."
            "\n        - Be polite, professional, and clear."
            "\n        - Use data and rule constraints in explanations."
            "\n        - Always mention specific numbers from the customer data when explaining decisions."
            "\n        - If the customer asks about improving eligibility, give actionable advice.\n        "
        ),
    )
    user = F.concat(
        F.lit("\n        Conversation History:\n        "), history,
        F.lit("\n\n        Customer Question: "), question, F.lit("\n        "),
    )
    return system, user
