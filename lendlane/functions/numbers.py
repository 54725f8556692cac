"""Turning text into numbers, with the accepted spellings spelled out.

Spark's own casts accept more ('1e5', '5d') and, in ANSI mode, raise; so each
parser checks the spelling first and then casts with `try_cast`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lendlane.functions.text import strip

# Accepted spellings.
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
LENIENT_NUMBER = r"^[+-]?([0-9]+|([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
STRICT_DECIMAL = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def parse_number(c: Column, default: float | None = None) -> Column:
    """Lenient: thousands commas are dropped; an exponent needs a decimal point."""
    t = strip(F.replace(c, F.lit(","), F.lit("")))
    n = F.when(F.rlike(t, F.lit(LENIENT_NUMBER)), t.try_cast("double"))
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def strict_int(c: Column) -> Column:
    """Whole numbers only; NULL for anything else ('28.5', '1,000', '')."""
    t = strip(c)
    return F.when(F.rlike(t, F.lit(WHOLE_NUMBER)), t.try_cast("bigint"))


def strict_float(c: Column) -> Column:
    """Decimal numbers with an optional exponent; NULL for anything else ('1,000', '5d')."""
    t = strip(c)
    return F.when(F.rlike(t, F.lit(STRICT_DECIMAL)), t.try_cast("double"))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(strict_int(c), F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strict_float(c), F.lit(float(default)))


def above(x: Column, bound) -> Column:
    """x > bound, where NaN is above nothing (Spark orders NaN last)."""
    return (x > F.lit(bound)) & ~F.isnan(x)
