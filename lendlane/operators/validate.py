"""Field validators. Each returns its messages as an array in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.numbers import above
from lendlane.functions.text import grouped, present, strip
from lendlane.operators.applicants import Applicants

# Required fields and their labels, in message order.
REQUIRED_FIELDS = [
    ("name", "Full Name"),
    ("age", "Age"),
    ("monthly_income", "Monthly Income"),
    ("employment_type", "Employment Type"),
    ("loan_amount_requested", "Loan Amount Requested"),
    ("credit_score", "Credit Score"),
]
ZERO_IS_MISSING = ("age", "monthly_income", "loan_amount_requested", "credit_score")
EMI_LABEL = "Monthly Loan Payment (EMI)"
# Accepted employment labels of the preflight.
ACCEPTED_EMPLOYMENT = ["Salaried", "Self-employed", "Business", "Student", "Unemployed", "Retired"]
SPECIAL_CHARACTERS = "!@#$%^&*()_+-=[]{}|;':,./<>?"
# Fixed value: largest loan amount the preflight accepts (10 crore).
LARGEST_LOAN = 100_000_000.0


def _blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def validate_required(df: DataFrame) -> DataFrame:
    """Add `missing_fields`, `errors` and `valid`: required fields first, then types and ranges.

    A field that is missing is not range-checked as well.
    """
    a = Applicants(df)
    lacking = {}
    for name, _ in REQUIRED_FIELDS:
        lacking[name] = _blank(a.text(name))
        if name in ZERO_IS_MISSING:
            lacking[name] = lacking[name] | a.is_zero(name)
    flagged = df.withColumns({f"lacks_{n}": c for n, c in lacking.items()} | {
        "v_age": a.whole("age"), "v_income": a.decimal("monthly_income"),
        "v_credit": a.whole("credit_score"), "v_amount": a.decimal("loan_amount_requested"),
    })
    no_emi = (a.text("existing_loan") == "Yes") & _blank(a.text("monthly_loan_payment"))
    age, income, credit, amount = (F.col(c) for c in ("v_age", "v_income", "v_credit", "v_amount"))

    def checked(name: str, value: Column, out_of_range: Column, range_message: str, type_message: str) -> Column:
        problem = F.when(value.isNull(), type_message).when(out_of_range, range_message)
        return F.when(~F.col(f"lacks_{name}"), problem)

    messages = {
        "missing_fields": present(
            *[F.when(F.col(f"lacks_{n}"), label) for n, label in REQUIRED_FIELDS],
            F.when(no_emi, EMI_LABEL),
        ),
        "errors": present(
            checked("age", age, (age < 18) | (age > 100),
                    "Age must be between 18 and 100.", "Age must be a valid number."),
            checked("monthly_income", income, income < 0,
                    "Monthly income cannot be negative.", "Monthly income must be a valid number."),
            checked("credit_score", credit, (credit < 300) | (credit > 900),
                    "Credit score must be between 300 and 900.", "Credit score must be a valid number."),
            checked("loan_amount_requested", amount, amount <= 0,
                    "Loan amount requested must be positive.", "Loan amount requested must be a valid number."),
        ),
    }
    return (
        flagged.withColumns(messages)
        .withColumn("valid", (F.size("missing_fields") == 0) & (F.size("errors") == 0))
        .drop(*[f"lacks_{n}" for n in lacking], "v_age", "v_income", "v_credit", "v_amount")
    )


def sanity_errors(age: Column, income: Column, credit: Column, requested: Column) -> Column:
    """Range checks over numbers already read; NULLs are not judged here."""
    # Ranges and wording.
    return present(
        F.when((age < 18) | (age > 100), "Age must be between 18 and 100."),
        F.when(income < 0, "Monthly income cannot be negative."),
        F.when((credit < 300) | (credit > 900), "Credit score must be between 300 and 900."),
        F.when(requested <= 0, "Loan amount requested must be a positive value."),
    )


def validate_ranges(df: DataFrame) -> DataFrame:
    """Add `errors`: the range checks alone, over leniently read numbers."""
    a = Applicants(df)
    numbers = df.withColumns({
        "v_age": a.number("age"), "v_income": a.number("monthly_income"),
        "v_credit": a.number("credit_score"), "v_amount": a.number("loan_amount_requested"),
    })
    errors = sanity_errors(F.col("v_age"), F.col("v_income"), F.col("v_credit"), F.col("v_amount"))
    return numbers.withColumn("errors", errors).drop("v_age", "v_income", "v_credit", "v_amount")


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def validate_preflight(df: DataFrame) -> DataFrame:
    """Add `errors`, value-bearing messages over all fields, plus `message` and `needs_more_info`."""
    a = Applicants(df)
    tidy = lambda name: strip(F.coalesce(a.text(name), F.lit("")))
    # A number column that is absent altogether reads as 0; a NULL in one is not a number.
    whole = lambda n: a.whole(n) if a.has(n) else F.lit(0).cast("bigint")
    decimal = lambda n: a.decimal(n) if a.has(n) else F.lit(0.0)
    read = df.withColumns({
        "v_name": tidy("name"), "v_purpose": tidy("loan_purpose"), "v_employment": tidy("employment_type"),
        "v_loan": tidy("existing_loan"),
        "v_age": whole("age"), "v_income": decimal("monthly_income"), "v_credit": whole("credit_score"),
        "v_amount": decimal("loan_amount_requested"), "v_emi": decimal("monthly_loan_payment"),
    })
    name, purpose, employment = F.col("v_name"), F.col("v_purpose"), F.col("v_employment")
    age, income, credit = F.col("v_age"), F.col("v_income"), F.col("v_credit")
    amount, emi, has_loan = F.col("v_amount"), F.col("v_emi"), F.col("v_loan") == "Yes"
    letters = F.replace(name, F.lit(" "), F.lit(""))
    only_special = F.translate(letters, SPECIAL_CHARACTERS, "") == ""

    errors = present(
        F.when(name == "", "Full Name is required. Please enter the applicant's name.")
        .when(F.length(name) < 2, "Full Name must be at least 2 characters long.")
        .when(F.rlike(letters, F.lit(r"^\p{Nd}+$")),
              "Full Name cannot consist entirely of numbers. Please enter a valid name.")
        .when(only_special, "Full Name appears to contain only special characters. Please enter a valid name."),
        F.when(age.isNull(), "Age must be a valid whole number.")
        .when(age == 0, "Age cannot be 0. Please enter the applicant's actual age.")
        .when(age < 18, _say("Age ", age.cast("string"), " is below the minimum eligibility age of 18 years."))
        .when(age > 100, _say("Age ", age.cast("string"), " exceeds the maximum allowed value of 100.")),
        F.when(income.isNull(), "Monthly Income must be a valid number.")
        .when(income < 0, "Monthly Income cannot be negative.")
        .when(income == 0, "Monthly Income is 0. If the applicant has no income, "
                           "they will not meet the bank's minimum lending requirements."),
        F.when(credit.isNull(), "Credit Score must be a valid whole number between 300 and 900.")
        .when(credit < 300, _say("Credit Score ", credit.cast("string"), " is below the valid range (300–900)."))
        .when(credit > 900, _say("Credit Score ", credit.cast("string"), " exceeds the valid range (300–900).")),
        F.when(amount.isNull(), "Loan Amount Requested must be a valid number.")
        .when(amount <= 0, "Loan Amount Requested must be greater than 0. "
                           "Please enter the amount the applicant wishes to borrow.")
        .when(above(amount, LARGEST_LOAN),
              _say("Loan Amount of Rs.", grouped(amount),
                   " exceeds the maximum supported limit of Rs.10,00,00,000 (10 Crore).")),
        F.when(purpose == "", "Loan Purpose is required. Please describe the intended use of the loan.")
        .when(F.length(purpose) < 3,
              _say("Loan Purpose '", purpose, "' is too short. Please provide a meaningful description "
                                              "(e.g. 'Home Renovation', 'Education').")),
        F.when(employment == "", "Employment Type is required.")
        .when(~employment.isin(ACCEPTED_EMPLOYMENT),
              _say("Employment Type '", employment, "' is not recognised. Accepted values: ",
                   F.array_join(F.array_sort(F.array(*[F.lit(x) for x in ACCEPTED_EMPLOYMENT])), ", "), ".")),
        F.when(emi.isNull(), "Monthly EMI/Loan Payment must be a valid number.")
        .when(emi < 0, "Monthly EMI/Loan Payment cannot be negative.")
        .when(has_loan & (emi == 0), "You indicated an existing loan but the monthly EMI/payment is 0. "
                                     "Please enter the actual monthly payment amount.")
        # The payment is compared with the income, so an unreadable income surfaces here too.
        .when(has_loan & income.isNull(), "Monthly EMI/Loan Payment must be a valid number.")
        .when(has_loan & above(income, 0.0) & (emi >= income) & ~F.isnan(emi),
              _say("Monthly EMI (Rs.", grouped(emi), ") equals or exceeds Monthly Income (Rs.",
                   grouped(income), "). Please verify these values.")),
    )
    listed = F.array_join(F.transform(F.col("errors"), lambda e: F.concat(F.lit("  • "), e)), "\n")
    message = _say("Please correct the following before we can proceed:\n\n", listed,
                   "\n\nOnce these are fixed, click **Launch Assessment** again.")
    return (
        read.withColumn("errors", errors)
        .withColumn("needs_more_info", F.size("errors") > 0)
        .withColumn("message", F.when(F.col("needs_more_info"), message))
        .drop("v_name", "v_purpose", "v_employment", "v_loan", "v_age", "v_income", "v_credit", "v_amount", "v_emi")
    )


def validation_reason(missing: Column, errors: Column) -> Column:
    """One sentence each for what is missing and what is wrong."""
    return F.concat(
        F.lit("Please complete all profile details."),
        F.when(F.size(missing) > 0, _say(" Missing fields: ", F.array_join(missing, ", "), ".")).otherwise(""),
        F.when(F.size(errors) > 0, _say(" Errors: ", F.array_join(errors, ", "), ".")).otherwise(""),
    )
