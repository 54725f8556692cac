"""The customer directory."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.operators.skew import join_unique
from lendlane.schemas import CUSTOMER_FILE

# Fixed value: purpose of a payload made from a directory row.
DIRECTORY_PURPOSE = "General Purchase"


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """The customer file with its known schema; an empty directory if there is no file."""
    try:
        return spark.read.schema(CUSTOMER_FILE).option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CUSTOMER_FILE)


def to_payload(customers: DataFrame) -> DataFrame:
    """Directory rows as applications: liabilities become the monthly payment."""
    whole = lambda n: F.col(n).cast("bigint")
    return customers.select(
        *[c for c in customers.columns if c not in ("name", "age", "monthly_income", "employment_type", "credit_score",
                                                    "existing_liabilities", "loan_amount_requested")],
        "name", whole("age").alias("age"), whole("monthly_income").alias("monthly_income"), "employment_type",
        whole("credit_score").alias("credit_score"),
        whole("existing_liabilities").alias("monthly_loan_payment"),
        F.when(whole("existing_liabilities") > 0, "Yes").otherwise("No").alias("existing_loan"),
        whole("loan_amount_requested").alias("loan_amount_requested"),
        F.lit(DIRECTORY_PURPOSE).alias("loan_purpose"),
    )


def lookup_by_name(requests: DataFrame, customers: DataFrame, order_by: str, spread_by: str, name: str = "name") -> DataFrame:
    """The first customer (by `order_by`) of each requested name; names nobody has find nothing.

    Equal names are reduced to their first row before the join, partly already
    before the shuffle, so a very common name is no hot spot on either side.
    """
    others = [c for c in customers.columns if c != name]
    first = customers.groupBy(name).agg(F.min_by(F.struct(*others), order_by).alias("found")).select(name, "found.*")
    return join_unique(requests, first, name)
