"""The cascade on rows worked out by hand, and the least qualifying income against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lendlane.config import DEFAULT_RULES_DOCUMENT, Rules
from lendlane.functions.finance import least_income_within
from lendlane.operators.decide import evaluate

SCHEMA = ("application_id long, age double, monthly_income double, employment_type string, credit_score double, "
          "existing_liabilities double, loan_amount_requested double")

# age, income, employment, credit, debt, amount -> verdict, score, stage, points, least income
CASES = [
    ((28, 65000, "Salaried", 780, 5000, 300000), ("Eligible", 100, "scored", (2, 2, 2, 2, 1), 0)),
    ((35, 42000, "Self-employed", 710, 12000, 250000), ("Conditionally Eligible", 55, "scored", (1, 1, 1, 1, 1), 50000)),
    ((23, 28000, "Salaried", 640, 3000, 150000), ("Not Eligible", 0, "income", (0, 0, 0, 0, 0), 30000)),
    ((41, 90000, "Business", 690, 40000, 500000), ("Not Eligible", 0, "debt", (2, 1, 0, 0, 0), 160000)),
    ((22, 12000, "Student", 580, 0, 50000), ("Not Eligible", 0, "income", (0, 0, 0, 0, 0), 0)),
    ((38, 75000, "Business", 620, 25000, 400000), ("Conditionally Eligible", 66, "scored", (2, 1, 1, 1, 1), 100000)),
    ((29, 35000, "Unemployed", 450, 5000, 100000), ("Not Eligible", 0, "credit", (1, 0, 0, 0, 0), 0)),
    ((62, 48000, "Retired", 790, 2000, 150000), ("Not Eligible", 0, "age", (0, 0, 0, 0, 0), 0)),
    ((33, 95000, "Salaried", 700, 50000, 600000), ("Not Eligible", 0, "debt", (2, 1, 0, 0, 0), 125000)),
    ((26, 25000, "Salaried", 720, 8000, 120000), ("Not Eligible", 0, "income", (0, 0, 0, 0, 0), 32000)),
    ((58, 52000, "Retired", 760, 4000, 250000), ("Eligible", 77, "scored", (2, 2, 2, 0, 1), 0)),
    ((26, 38000, "Salaried", 655, 10000, 200000), ("Conditionally Eligible", 66, "scored", (1, 1, 1, 2, 1), 40000)),
    # Bounds.
    ((20, 65000, "Salaried", 780, 0, 1), ("Not Eligible", 0, "age", (0, 0, 0, 0, 0), 0)),
    ((21, 50000, "Salaried", 750, 12500, 1000000), ("Eligible", 100, "scored", (2, 2, 2, 2, 1), 0)),
    ((60, 49999, "Salaried", 749, 0, 1), ("Eligible", 77, "scored", (1, 1, 2, 2, 1), 0)),
    ((61, 50000, "Salaried", 750, 0, 1), ("Not Eligible", 0, "age", (0, 0, 0, 0, 0), 0)),
    ((30, 29999, "Salaried", 750, 0, 1), ("Not Eligible", 0, "income", (0, 0, 0, 0, 0), 30000)),
    ((30, 50000, "Salaried", 599, 0, 1), ("Not Eligible", 0, "credit", (2, 0, 0, 0, 0), 0)),
    ((30, 50000, "Salaried", 600, 20000, 1), ("Eligible", 77, "scored", (2, 1, 1, 2, 1), 0)),
    ((30, 50000, "Student", 600, 20001, 1), ("Not Eligible", 0, "debt", (2, 1, 0, 0, 0), 0)),
    ((30, 50000, "Student", 600, 20000, 1000001), ("Not Eligible", 33, "scored", (2, 1, 1, -1, 0), 0)),
    ((30, None, "Salaried", 750, 0, 1), ("Not Eligible", 0, "missing", (0, 0, 0, 0, 0), 0)),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = [(i, *[float(x) if isinstance(x, int) else x for x in c[0]]) for i, c in enumerate(CASES)]
    return {r["application_id"]: r for r in evaluate(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(decided, i):
    row, (verdict, score, stage, points, needed) = decided[i], CASES[i][1]
    assert (row["eligibility"], row["score"], row["stage"]) == (verdict, score, stage)
    assert tuple(row["scoring_breakdown"]) == points
    assert row["required_income_for_eligibility"] == needed


def test_reasons_keep_order(decided):
    low, debt = "Monthly income is below the minimum baseline.", "Existing liabilities are high relative to income."
    assert decided[1]["reasons"] == [low, debt]
    assert decided[6]["reasons"] == [low, "Credit score is below the acceptable lending threshold."]
    assert decided[16]["reasons"] == [low] and decided[16]["next_steps"] == ["Income below baseline."]
    assert decided[20]["next_steps"] == []
    assert decided[21]["reasons"] == ["Required data is missing or invalid format."]


def verdict(age, income, employment, credit, debt, amount):
    """A plain reading of the rules for one applicant and one income."""
    if not 21 <= age <= 60 or credit < 600 or income < 30000 or debt / income > 0.4:
        return 0
    part = {"Salaried": 2, "Self-employed": 1, "Business": 1, "Student": -1, "Unemployed": -1}.get(employment, 0)
    return (1 + (income >= 50000)) + (1 + (credit >= 750)) + (1 + (debt / income <= 0.25)) + part + (amount / income <= 20)


def search(row):
    age, income, employment, credit, debt, amount = row
    works = lambda i: verdict(age, i, employment, credit, debt, amount) >= 7
    low, high = int(income), 1_000_000
    if works(income) or not works(high):
        return 0.0
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if works(middle) else (middle + 1, high)
    return float(low)


def test_least_income_is_what_a_search_finds(spark):
    pick = random.Random(7)
    labels = ["Salaried", "Self-employed", "Business", "Student", "Unemployed", "Retired"]
    rows = []
    for _ in range(4000):
        whole = pick.random() < 0.5
        number = (lambda hi: float(pick.randint(0, hi))) if whole else (lambda hi: pick.random() * hi)
        rows.append((float(pick.randint(19, 62)), number(120000), pick.choice(labels), float(pick.randint(560, 860)),
                     number(pick.choice([1000, 30000, 400000])), number(pick.choice([100000, 3000000, 25000000]))))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = {r[0]: r[1] for r in evaluate(table).select("application_id", "required_income_for_eligibility").collect()}
    expected = {i: search(r) for i, r in enumerate(rows)}
    assert sum(v > 0 for v in expected.values()) > 500
    assert {i: (got[i], e, rows[i]) for i, e in expected.items() if got[i] != e} == {}


def test_least_income_within(spark):
    amounts = [float(a) for a in range(0, 3000, 7)] + [0.1 * a for a in range(1, 400)] + [-5.0]
    rows = spark.createDataFrame([(a,) for a in amounts], "a double")
    for ratio in (0.25, 0.4, 20.0):
        for a, i in rows.select("a", least_income_within(F.col("a"), ratio)).collect():
            assert a / i <= ratio and (i == 1 or a / (i - 1) > ratio), (a, ratio, i)


def test_rules_are_parameters(spark):
    document = {**DEFAULT_RULES_DOCUMENT, "thresholds": {**DEFAULT_RULES_DOCUMENT["thresholds"], "max_age": 70}}
    row = spark.createDataFrame([(1, 62.0, 65000.0, "Salaried", 780.0, 0.0, 1.0)], SCHEMA)
    assert evaluate(row).first()["stage"] == "age"
    assert evaluate(row, Rules.from_document(document)).first()["eligibility"] == "Eligible"


def test_debt_falls_back_to_the_payment(spark):
    rows = [("1", None, "100"), ("2", "", "100"), ("3", "0", "100"), ("4", "70", "100"), ("5", "abc", "100"), ("6", None, None)]
    df = spark.createDataFrame(rows, "application_id string, existing_liabilities string, monthly_loan_payment string")
    got = {r[0]: r[1] for r in evaluate(df).select("application_id", "key_factors.existing_liabilities").collect()}
    assert got == {"1": 100.0, "2": 100.0, "3": 100.0, "4": 70.0, "5": 0.0, "6": 0.0}


def test_strict_mode(spark):
    rows = [(1, 17.0, -1.0, "Salaried", 950.0, 0.0, 0.0), (2, 30.0, 65000.0, "Salaried", 780.0, 0.0, 1.0)]
    bad, good = evaluate(spark.createDataFrame(rows, SCHEMA), strict=True).orderBy("application_id").collect()
    assert bad["reasons"] == ["Age must be between 18 and 100.", "Monthly income cannot be negative.",
                              "Credit score must be between 300 and 900.", "Loan amount requested must be a positive value."]
    assert bad["estimated_terms"]["risk_category"] == "Invalid Input" and set(bad["scoring_breakdown"]) == {None}
    assert good["eligibility"] == "Eligible"


def test_one_narrow_stage(spark):
    rows = spark.createDataFrame([(2, 30.0, 65000.0, "Salaried", 780.0, 0.0, 1.0)], SCHEMA)
    plan = evaluate(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Join"))
