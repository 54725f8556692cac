"""Ratios, score bands and indicative terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lowest score of a band -> (interest rate, tenure, risk).
TERM_BANDS = [
    (90, "8.25% - 8.75%", "Up to 30 years", "Very Low"),
    (75, "8.75% - 9.50%", "Up to 25 years", "Low"),
    (50, "9.50% - 11.00%", "Up to 20 years", "Moderate"),
    (30, "11.00% - 14.50%", "Up to 15 years", "High"),
    (0, "N/A", "N/A", "Very High"),
]
# Processing fee below and from the cut.
FEE_CUT = 80
FEE_FROM_CUT = "0.5% - 1.0%"
FEE_BELOW_CUT = "1.0% - 2.0%"
# Least total points for a verdict, and the most points there are.
ELIGIBLE_POINTS = 7
CONDITIONAL_POINTS = 4
MAX_POINTS = 9

ELIGIBLE, CONDITIONAL, NOT_ELIGIBLE = "Eligible", "Conditionally Eligible", "Not Eligible"


def debt_to_income(debt: Column, income: Column) -> Column:
    return F.when(income != 0, debt / income).otherwise(F.lit(1.0))


def round_to_tenths(x: Column) -> Column:
    """Round to one place; a value exactly halfway goes to the even neighbour.

    Halfway is judged on the double itself, as Python does, not on its decimal
    spelling: 2.45 is stored a little above 2.45 and becomes 2.5, 2.25 is exact
    and becomes 2.2. With k tenths below x, 20x is compared with 2k + 1; the sum
    16x + 4x carries its rounding error along, so the comparison is exact.
    """
    a, b = x * 16.0, x * 4.0
    total = a + b
    part = total - a
    error = (a - (total - part)) + (b - part)
    tenths = F.floor(x * 10.0).cast("double")
    halfway = tenths * 2.0 + 1.0
    odd = F.pmod(tenths, F.lit(2.0)) == 1.0
    up = (total > halfway) | ((total == halfway) & ((error > 0.0) | ((error == 0.0) & odd)))
    return F.when(up, tenths + 1.0).otherwise(tenths) / 10.0


def debt_percent(debt: Column, income: Column) -> Column:
    """Debt-to-income in percent to one place; 0 without income."""
    share = F.when(F.coalesce(income, F.lit(0.0)) != 0, debt / income * 100.0)
    return F.coalesce(round_to_tenths(share), F.lit(0.0))


def loan_multiple(requested: Column, income: Column) -> Column:
    return F.when(income != 0, requested / income).otherwise(F.lit(999.0))


def normalized_score(points: Column) -> Column:
    share = F.floor(points / F.lit(float(MAX_POINTS)) * 100).cast("int")
    return F.least(F.lit(100), F.greatest(F.lit(0), share))


def verdict_of(points: Column) -> Column:
    return (
        F.when(points >= ELIGIBLE_POINTS, ELIGIBLE)
        .when(points >= CONDITIONAL_POINTS, CONDITIONAL)
        .otherwise(NOT_ELIGIBLE)
    )


def _ladder(score: Column, position: int) -> Column:
    top = F.when(score >= TERM_BANDS[0][0], TERM_BANDS[0][position])
    for band in TERM_BANDS[1:-1]:
        top = top.when(score >= band[0], band[position])
    return top.otherwise(TERM_BANDS[-1][position])


def loan_terms(score: Column) -> Column:
    return F.struct(
        _ladder(score, 1).alias("estimated_interest_rate"),
        _ladder(score, 2).alias("maximum_tenure"),
        _ladder(score, 3).alias("risk_category"),
        F.when(score >= FEE_CUT, FEE_FROM_CUT).otherwise(FEE_BELOW_CUT).alias("processing_fee"),
    )


def least_income_within(amount: Column, ratio: float) -> Column:
    """Least whole income for which amount / income <= ratio.

    The quotient amount / ratio may be off by a rounding step, so its ceiling
    and both neighbours are tried against the comparison that will be made.
    """
    start = F.greatest(F.ceil(amount / F.lit(ratio)).cast("double"), F.lit(1.0))
    below = F.try_divide(amount, start - 1)
    return (
        F.when((start > 1) & (below <= ratio), start - 1)
        .when(amount / start <= ratio, start)
        .otherwise(start + 1)
    )
