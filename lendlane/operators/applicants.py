"""Reading applicant fields, whether a column is text, numeric or not there at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlane.functions.employment import normalize_employment
from lendlane.functions.numbers import parse_number, strict_float, strict_int

# Applicant fields in the order in which they are screened and echoed.
FIELD_ORDER = [
    "name", "age", "monthly_income", "employment_type", "credit_score", "existing_liabilities",
    "existing_loan", "monthly_loan_payment", "loan_amount_requested", "loan_purpose",
]
# Fixed value: purpose shown when an application carries none.
NO_PURPOSE = "Not Specified"


class Applicants:
    """Typed access to the applicant columns of a table of applications.

    A column is raw (text, as files and forms deliver it), typed (a number), or a VARIANT
    (dynamic), whose type is looked at in each row. Absent columns read as NULL.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def has(self, name: str) -> bool:
        return name in self._types

    def is_text(self, name: str) -> bool:
        return isinstance(self._types.get(name), T.StringType)

    def is_variant(self, name: str) -> bool:
        return isinstance(self._types.get(name), T.VariantType)

    def _is_said(self, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.col(name)) == "STRING", F.lit(False))

    def said(self, name: str) -> Column:
        """What was given as text; NULL for a number."""
        return F.when(self._is_said(name), self.text(name)) if self.is_variant(name) else self.text(name)

    def _dynamic(self, name: str, read, kind: str) -> Column:
        """A VARIANT's number: a text is read, anything else is cast."""
        return F.when(self._is_said(name), read(self.text(name))).otherwise(F.try_variant_get(F.col(name), "$", kind))

    def text(self, name: str) -> Column:
        if not self.has(name):
            return F.lit(None).cast("string")
        if self.is_variant(name):
            return F.try_variant_get(F.col(name), "$", "string")
        return F.col(name) if self.is_text(name) else F.col(name).cast("string")

    def number(self, name: str) -> Column:
        """Lenient reading, as the scoring cascade uses it."""
        if not self.has(name):
            return F.lit(None).cast("double")
        if self.is_variant(name):
            return self._dynamic(name, parse_number, "double")
        return parse_number(F.col(name)) if self.is_text(name) else F.col(name).cast("double")

    def decimal(self, name: str) -> Column:
        """Strict reading of a number, as the validators use it."""
        if not self.has(name):
            return F.lit(None).cast("double")
        if self.is_variant(name):
            return self._dynamic(name, strict_float, "double")
        return strict_float(F.col(name)) if self.is_text(name) else F.col(name).cast("double")

    def whole(self, name: str) -> Column:
        """Strict reading of a whole number; numeric columns lose their fraction, text may not have one."""
        if not self.has(name):
            return F.lit(None).cast("bigint")
        if self.is_variant(name):
            return self._dynamic(name, strict_int, "bigint")
        return strict_int(F.col(name)) if self.is_text(name) else F.col(name).cast("bigint")

    def is_zero(self, name: str) -> Column:
        """True for a zero.

        In a text column a zero counts as the number 0, since files and forms deliver numbers;
        in a dynamic one a text is a text.
        """
        if self.is_variant(name):
            return ~self._is_said(name) & F.coalesce(self.decimal(name) == 0, F.lit(False))
        return F.coalesce(self.decimal(name) == 0, F.lit(False))

    def debt(self) -> Column:
        """Existing liabilities, or the monthly payment where those are NULL, empty or zero; else 0.

        Text that is there but is not a number counts as 0; it does not fall back.
        """
        stated = self.text("existing_liabilities")
        absent = stated.isNull() | (stated == "") | self.is_zero("existing_liabilities")
        chosen = F.when(absent, self.number("monthly_loan_payment")).otherwise(self.number("existing_liabilities"))
        return F.coalesce(chosen, F.lit(0.0))

    def employment(self) -> Column:
        return normalize_employment(self.text("employment_type"))

    def with_factors(self) -> DataFrame:
        """Add the normalised fields as flat `f_` columns.

        They stay flat so that each text is parsed once per row: Catalyst keeps
        costly expressions that several later columns use in their own projection.
        """
        return self.df.withColumns({
            "f_name": F.coalesce(self.text("name"), F.lit("")),
            "f_age": self.number("age"),
            "f_income": self.number("monthly_income"),
            "f_employment": self.employment(),
            "f_credit": self.number("credit_score"),
            "f_debt": self.debt(),
            "f_requested": self.number("loan_amount_requested"),
            "f_purpose": F.coalesce(self.text("loan_purpose"), F.lit(NO_PURPOSE)),
        })


def key_factors() -> Column:
    """The eight normalised fields as one struct, from the `f_` columns."""
    return F.struct(
        F.col("f_name").alias("name"),
        F.col("f_age").alias("age"),
        F.col("f_income").alias("monthly_income"),
        F.col("f_employment").alias("employment_type"),
        F.col("f_credit").alias("credit_score"),
        F.col("f_debt").alias("existing_liabilities"),
        F.col("f_requested").alias("loan_amount_requested"),
        F.col("f_purpose").alias("loan_purpose"),
    )
