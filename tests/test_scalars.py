import pytest
from pyspark.sql import functions as F

from lendlane.functions import finance
from lendlane.functions.employment import normalize_employment
from lendlane.functions.numbers import parse_number, safe_float, safe_int, strict_float, strict_int
from lendlane.functions.text import WHITESPACE, clamp_text, grouped_number, plain_number, quoted, title_case

SPELLINGS = [
    "0", "12", " 12 ", "-5", "+7", "1,234,567", "1e5", "1.5e3", ".5", "5.", ".", "", " ", "abc", "12abc", "5d", "5f", "0x10",
    "28.5", "-0.0", "1.2.3", "--1", "\t9\n", " 9 ", "1 2", "1.e2", "1,2.5", "e5", "1.5e", "99999999999",
]


def one_column(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def attempt(read, text):
    try:
        return read(text)
    except ValueError:
        return None


def test_parse_number(spark):
    def lenient(text):
        t = text.replace(",", "").strip()
        return attempt(float if "." in t else int, t)

    assert one_column(spark, SPELLINGS, parse_number(F.col("v"))) == [lenient(s) for s in SPELLINGS]
    assert one_column(spark, [None, "", "x"], parse_number(F.col("v"), 0)) == [0.0, 0.0, 0.0]


def test_strict_numbers(spark):
    assert one_column(spark, SPELLINGS, strict_int(F.col("v"))) == [attempt(int, s) for s in SPELLINGS]
    assert one_column(spark, SPELLINGS, strict_float(F.col("v"))) == [attempt(float, s) for s in SPELLINGS]
    assert one_column(spark, ["30.5", None, "7"], safe_int(F.col("v"))) == [0, 0, 7]
    assert one_column(spark, ["30.5", None, "1e2"], safe_float(F.col("v"))) == [30.5, 0.0, 100.0]
    assert one_column(spark, ["inf", "-Infinity"], strict_float(F.col("v"))) == [float("inf"), float("-inf")]


def test_white_space_is_pythons():
    assert WHITESPACE and all(c.isspace() for c in WHITESPACE)
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_employment(spark):
    given = [" SALARIED ", "self employed", "Self-Employed", "o'neil-smith 2nd", None, "", "RETIRED"]
    expected = ["Salaried", "Self-employed", "Self-employed", "O'Neil-Smith 2Nd", "", "", "Retired"]
    assert one_column(spark, given, normalize_employment(F.col("v"))) == expected
    words = ["x-ray 2go", "ÉCOLE élan", "a.b_c"]
    assert one_column(spark, words, title_case(F.col("v"))) == [w.title() for w in words]


def test_texts(spark):
    assert one_column(spark, [None, "  abc  ", "x" * 200], clamp_text(F.col("v"))) == ["", "abc", "x" * 120]
    assert one_column(spark, ["a", "it's", 'say "hi"', "it's \"x\"", "b\\c"], quoted(F.col("v"))) == [
        repr(t) for t in ["a", "it's", 'say "hi"', "it's \"x\"", "b\\c"]
    ]
    number = F.col("v").cast("double")
    assert one_column(spark, ["65000", "28.5", "-3", "12345678.5", "0.0002", "10000000000000000"], plain_number(number)) == [
        "65000", "28.5", "-3", "12345678.5", "0.0002", "10000000000000000"]
    assert one_column(spark, ["1234567", "1234.5", "12"], grouped_number(number)) == ["1,234,567", "1,234.5", "12"]


@pytest.mark.parametrize("score,rate,risk,fee", [
    (100, "8.25% - 8.75%", "Very Low", "0.5% - 1.0%"), (90, "8.25% - 8.75%", "Very Low", "0.5% - 1.0%"),
    (89, "8.75% - 9.50%", "Low", "0.5% - 1.0%"), (79, "8.75% - 9.50%", "Low", "1.0% - 2.0%"),
    (74, "9.50% - 11.00%", "Moderate", "1.0% - 2.0%"), (49, "11.00% - 14.50%", "High", "1.0% - 2.0%"),
    (29, "N/A", "Very High", "1.0% - 2.0%"),
])
def test_terms(spark, score, rate, risk, fee):
    terms = spark.range(1).select(finance.loan_terms(F.lit(score)).alias("t")).first()["t"]
    assert (terms["estimated_interest_rate"], terms["risk_category"], terms["processing_fee"]) == (rate, risk, fee)


def test_scores(spark):
    points = spark.range(2, 10).select(finance.normalized_score(F.col("id")).alias("s")).collect()
    assert [p["s"] for p in points] == [22, 33, 44, 55, 66, 77, 88, 100]


def test_percent_rounds_as_python_does(spark):
    df = spark.createDataFrame([(2.25, 100.0), (1.0, 0.0), (5.0, None)], "debt double, income double")
    assert [r[0] for r in df.select(finance.debt_percent(F.col("debt"), F.col("income"))).collect()] == [2.2, 0.0, 0.0]
    values = [i / 100 for i in range(0, 20000, 5)] + [i / 8 for i in range(400)] + [i / 7 * 100 for i in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", finance.round_to_tenths(F.col("x")))
    assert [(x, got) for x, got in rows.collect() if got != round(x, 1)] == []
