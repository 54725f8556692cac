"""The scoring cascade: stage, points, verdict, reasons, terms, least qualifying income.

Everything is a chain of projections over one row, so a whole table is scored
in a single narrow stage: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.config import DEFAULT_RULES, INCOME_CAP, Rules
from lendlane.functions import finance
from lendlane.functions.employment import employment_points
from lendlane.functions.text import literals, present
from lendlane.operators.applicants import Applicants, key_factors
from lendlane.operators.validate import sanity_errors
from lendlane.operators.range_join import range_join

# Wording of the outcomes that have no entry in the rules.
MISSING_REASON = "Required data is missing or invalid format."
NEXT_STEPS = {
    "invalid": "Please provide valid banking information.",
    "missing": "Provide all required details.",
    "age": "Check age eligibility.",
    "income": "Income below baseline.",
    "credit": "Improve credit score.",
    "debt": "Reduce debt ratio.",
}
ELIGIBLE_STEP = "Submit standard KYC."
CONDITIONAL_STEP = "Provide additional documents."
EXIT_RISK = "Very High"
INVALID_RISK = "Invalid Input"

RESULT_COLUMNS = [
    "stage", "eligibility", "score", "key_factors", "reasons", "next_steps", "scoring_breakdown",
    "estimated_terms", "required_income_for_eligibility",
]


def income_points(income: Column, rules: Rules) -> Column:
    return F.when(income >= rules.full_income, 2).when(income >= rules.base_income, 1).otherwise(0)


def credit_points(credit: Column, rules: Rules) -> Column:
    return F.when(credit >= rules.excellent_credit, 2).when(credit >= rules.minimum_credit, 1).otherwise(0)


def debt_points(ratio: Column, rules: Rules) -> Column:
    return F.when(ratio <= rules.low_debt_ratio, 2).when(ratio <= rules.high_debt_ratio, 1).otherwise(0)


def request_points(multiple: Column, rules: Rules) -> Column:
    return F.when(multiple <= rules.max_loan_multiple, 1).otherwise(0)


def _age_fits(age: Column, rules: Rules) -> Column:
    return (age >= rules.min_age) & (age <= rules.max_age)


def _any_missing(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def with_cascade(df: DataFrame, rules: Rules = DEFAULT_RULES, strict: bool = False) -> DataFrame:
    """Add `stage` (where the cascade ended), the ratios and the points of each part.

    Stages: invalid (strict only), missing, age, income, credit, debt, scored.
    Points are kept up to the stage that ended the cascade and are 0 after it.
    """
    age, income, credit = F.col("f_age"), F.col("f_income"), F.col("f_credit")
    ratios = df.withColumns({
        "dti": finance.debt_to_income(F.col("f_debt"), income),
        "lti": finance.loan_multiple(F.col("f_requested"), income),
        "raw_income_points": income_points(income, rules),
        "raw_credit_points": credit_points(credit, rules),
    }).withColumns({
        "raw_debt_points": debt_points(F.col("dti"), rules),
        "raw_request_points": request_points(F.col("lti"), rules),
    })
    missing = _any_missing(age, income, credit, F.col("f_requested"))
    stage = (
        F.when(missing, "missing")
        .when(~_age_fits(age, rules), "age")
        .when(F.col("raw_income_points") == 0, "income")
        .when(F.col("raw_credit_points") == 0, "credit")
        .when(F.col("raw_debt_points") == 0, "debt")
        .otherwise("scored")
    )
    if strict:
        ratios = ratios.withColumn("sanity_errors", sanity_errors(age, income, credit, F.col("f_requested")))
        stage = F.when(F.size("sanity_errors") > 0, "invalid").otherwise(stage)
    staged = ratios.withColumn("stage", stage)
    past_income = F.col("stage").isin("credit", "debt", "scored")
    past_credit = F.col("stage").isin("debt", "scored")
    scored = F.col("stage") == "scored"
    return staged.withColumns({
        "p_income": F.when(past_income, F.col("raw_income_points")).otherwise(0),
        "p_credit": F.when(past_credit, F.col("raw_credit_points")).otherwise(0),
        "p_debt": F.when(scored, F.col("raw_debt_points")).otherwise(0),
        "p_employment": F.when(scored, employment_points(F.col("f_employment"))).otherwise(0),
        "p_request": F.when(scored, F.col("raw_request_points")).otherwise(0),
    })


def total_points() -> Column:
    return F.col("p_income") + F.col("p_credit") + F.col("p_debt") + F.col("p_employment") + F.col("p_request")


def with_verdict(df: DataFrame) -> DataFrame:
    """Add total points, score and verdict; every early exit scores 0 and is not eligible."""
    scored = F.col("stage") == "scored"
    return df.withColumn("points", total_points()).withColumns({
        "score": F.when(scored, finance.normalized_score(F.col("points"))).otherwise(0),
        "eligibility": F.when(scored, finance.verdict_of(F.col("points"))).otherwise(finance.NOT_ELIGIBLE),
    })


def verdict_at_income(test_income: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """The verdict if only the income were `test_income` (over the `f_` columns)."""
    debt = debt_points(finance.debt_to_income(F.col("f_debt"), test_income), rules)
    request = request_points(finance.loan_multiple(F.col("f_requested"), test_income), rules)
    earned, credit = income_points(test_income, rules), credit_points(F.col("f_credit"), rules)
    stops = (
        _any_missing(F.col("f_age"), F.col("f_credit"), F.col("f_requested"))
        | ~_age_fits(F.col("f_age"), rules)
        | (credit == 0) | (earned == 0) | (debt == 0)
    )
    total = earned + credit + debt + employment_points(F.col("f_employment")) + request
    return F.when(stops, finance.NOT_ELIGIBLE).otherwise(finance.verdict_of(total))


def least_qualifying_income(rules: Rules = DEFAULT_RULES, cap: int = INCOME_CAP) -> Column:
    """Least whole income, not under the current one and not over `cap`, that makes the row Eligible; else 0.

    A higher income never lowers a part's points, so each mix of income, debt
    and request points that reaches the mark has one least income: the largest
    of its parts' bounds. The answer is the least over those mixes, in closed form.
    """
    debt, requested, income = F.col("f_debt"), F.col("f_requested"), F.col("f_income")
    credit = credit_points(F.col("f_credit"), rules)
    short = F.lit(finance.ELIGIBLE_POINTS) - credit - employment_points(F.col("f_employment"))
    current = F.coalesce(income, F.lit(0.0))
    floor = F.when(current < 0, F.ceil(current)).otherwise(F.floor(current)).cast("double")
    for_income = {1: F.lit(rules.base_income), 2: F.lit(rules.full_income)}
    for_debt = {
        1: finance.least_income_within(debt, rules.high_debt_ratio),
        2: finance.least_income_within(debt, rules.low_debt_ratio),
    }
    for_request = finance.least_income_within(requested, rules.max_loan_multiple)
    mixes = []
    for i in (1, 2):
        for d in (1, 2):
            for r in (0, 1):
                bounds = [floor, F.ceil(for_income[i]).cast("double"), for_debt[d]] + ([for_request] if r else [])
                mixes.append(F.when(short <= i + d + r, F.greatest(*bounds)))
    best = F.least(*mixes)
    possible = (
        ~_any_missing(F.col("f_age"), F.col("f_credit"), requested)
        & _age_fits(F.col("f_age"), rules) & (credit > 0)
    )
    return F.when(possible & (best <= float(cap)), best).otherwise(F.lit(0.0))


def needed_income(rules: Rules = DEFAULT_RULES) -> Column:
    """Least qualifying income for rows that more income could help; 0 for all others."""
    helped = F.col("stage").isin("income", "debt") | (
        (F.col("stage") == "scored") & (F.col("eligibility") != finance.ELIGIBLE)
    )
    return F.when(helped, least_qualifying_income(rules)).otherwise(F.lit(0.0))


def reasons_of(rules: Rules = DEFAULT_RULES, strict: bool = False) -> Column:
    w, stage = rules.wording, F.col("stage")
    past_income = stage.isin("credit", "debt", "scored")
    below_full_income = (stage == "income") | (past_income & (F.col("raw_income_points") == 1))
    above_low_debt = (stage == "debt") | ((stage == "scored") & (F.col("raw_debt_points") == 1))
    flags = present(
        F.when(stage == "missing", MISSING_REASON),
        F.when(stage == "age", w["age_out_of_range"]),
        F.when(below_full_income, w["low_income"]),
        F.when(stage == "credit", w["low_credit"]),
        F.when(above_low_debt, w["high_liabilities"]),
        F.when((stage == "scored") & (F.col("raw_request_points") == 0), w["requested_amount_high"]),
        F.when(F.col("eligibility") == finance.ELIGIBLE, w["positive_profile"]),
    )
    return F.when(stage == "invalid", F.col("sanity_errors")).otherwise(flags) if strict else flags


def next_steps_of() -> Column:
    step = F.when(F.col("eligibility") == finance.ELIGIBLE, ELIGIBLE_STEP).when(
        F.col("eligibility") == finance.CONDITIONAL, CONDITIONAL_STEP
    )
    for stage, text in NEXT_STEPS.items():
        step = step.when(F.col("stage") == stage, text)
    return present(step)


def breakdown_of() -> Column:
    """Points per part; empty (all NULL) for rows that failed the sanity step."""
    shown = F.col("stage") != "invalid"
    return F.struct(
        F.when(shown, F.col("p_income")).alias("income"),
        F.when(shown, F.col("p_credit")).alias("credit_score"),
        F.when(shown, F.col("p_debt")).alias("liabilities"),
        F.when(shown, F.col("p_employment")).alias("employment"),
        F.when(shown, F.col("p_request")).alias("loan_request"),
    )


def terms_of() -> Column:
    full = finance.loan_terms(F.col("score"))
    scored = F.col("stage") == "scored"
    exit_risk = F.when(F.col("stage") == "invalid", INVALID_RISK).otherwise(EXIT_RISK)
    part = lambda name: F.when(scored, full.getField(name)).alias(name)
    return F.struct(
        part("estimated_interest_rate"),
        part("maximum_tenure"),
        F.when(scored, full.getField("risk_category")).otherwise(exit_risk).alias("risk_category"),
        part("processing_fee"),
    )


def score_applicants(df: DataFrame, rules: Rules = DEFAULT_RULES, strict: bool = False) -> DataFrame:
    """Factors, cascade and verdict as flat columns; the base of every decision query."""
    return with_verdict(with_cascade(Applicants(df).with_factors(), rules, strict))


def evaluate(df: DataFrame, rules: Rules = DEFAULT_RULES, strict: bool = False) -> DataFrame:
    """Add the evaluation of each application (`RESULT_COLUMNS`) to the table.

    `strict` puts range checks first, as the tool interface does.
    """
    scored = score_applicants(df, rules, strict)
    full = scored.withColumns({
        "key_factors": key_factors(),
        "reasons": reasons_of(rules, strict),
        "next_steps": next_steps_of(),
        "scoring_breakdown": breakdown_of(),
        "estimated_terms": terms_of(),
        "required_income_for_eligibility": needed_income(rules),
    })
    return full.select(*df.columns, *RESULT_COLUMNS)


def required_documents(eligibility: Column) -> Column:
    # Documents to ask for, per verdict.
    eligible = [
        "Government Issued ID (PAN/Aadhaar)",
        "Proof of Address",
        "Last 3 Months Salary Slips",
        "Bank Statements (Last 6 Months)",
    ]
    conditional = [
        "Government Issued ID (PAN/Aadhaar)",
        "Proof of Address",
        "Last 6 Months Salary Slips or Form 16",
        "Bank Statements (Last 6 Months)",
        "Proof of Additional Assets or Guarantor Guarantee Details",
    ]
    other = [
        "Government Issued ID (PAN/Aadhaar)",
        "Proof of Income",
        "Credit Score Rectification Statement",
    ]
    return (
        F.when(eligibility == finance.ELIGIBLE, literals(eligible))
        .when(eligibility == finance.CONDITIONAL, literals(conditional))
        .otherwise(literals(other))
    )


def confidence(eligibility: Column, valid: Column, error_count: Column) -> Column:
    return (
        F.when(~F.coalesce(valid, F.lit(False)) | (error_count > 0), "LOW")
        .when(eligibility == finance.ELIGIBLE, "HIGH")
        .when(eligibility == finance.CONDITIONAL, "MODERATE")
        .otherwise("LOW")
    )


def terms_by_band_join(df: DataFrame) -> DataFrame:
    """The indicative terms by joining the band table instead of a ladder of conditions.

    Scores are whole numbers from 0 to 100, so each band is laid out as the
    scores it covers and the range join becomes an equality join against at most
    101 rows, whatever the size of the table; that is the bound that allows the broadcast.
    """
    spark = df.sparkSession
    scores = spark.range(0, 101).select(F.col("id").cast("int").alias("score"))
    bands = scores.withColumn("terms", finance.loan_terms(F.col("score"))).select("score", "terms.*")
    return df.join(F.broadcast(bands), "score", "left")


def term_bands(spark) -> DataFrame:
    """The bands of indicative terms as a table: from `band_low` to below `band_high`, open at both ends of the scale."""
    cuts = sorted({band[0] for band in finance.TERM_BANDS[:-1]} | {finance.FEE_CUT})
    rows = list(zip([None, *cuts], [*cuts, None]))
    bands = spark.createDataFrame(rows, "band_low int, band_high int")
    inside = F.coalesce(F.col("band_low"), F.lit(cuts[0] - 1))
    return bands.withColumn("terms", finance.loan_terms(inside)).select("band_low", "band_high", "terms.*")


def terms_by_interval_join(df: DataFrame, bands: DataFrame | None = None, key: str = "application_id") -> DataFrame:
    """The indicative terms by joining scores of any kind, fractions too, to the bands that hold them."""
    bands = term_bands(df.sparkSession) if bands is None else bands
    return range_join(df, bands, "score", "band_low", "band_high", "left", key, closed="left").drop("band_low", "band_high")
