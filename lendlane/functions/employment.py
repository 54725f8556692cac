"""Employment labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lendlane.functions.text import strip, title_case

# Spelling (lower case) -> label.
EMPLOYMENT_LABELS = {
    "salaried": "Salaried",
    "self-employed": "Self-employed",
    "self employed": "Self-employed",
    "business": "Business",
    "student": "Student",
    "unemployed": "Unemployed",
    "retired": "Retired",
}


def normalize_employment(c: Column) -> Column:
    """Known spellings to their label, others to title case, NULL to empty."""
    t = strip(F.coalesce(c, F.lit("")))
    labels = F.create_map(*[F.lit(x) for pair in EMPLOYMENT_LABELS.items() for x in pair])
    known = labels[F.lower(t)]
    return F.when(known.isNotNull(), known).otherwise(title_case(t))


def employment_points(label: Column) -> Column:
    return (
        F.when(label == "Salaried", 2)
        .when(label.isin("Self-employed", "Business"), 1)
        .when(label.isin("Student", "Unemployed"), -1)
        .otherwise(0)
    )
