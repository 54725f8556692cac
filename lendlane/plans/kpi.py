"""Figures over the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Decisions that are counted, and what the chart calls them. Blocked rows are in no bucket.
BUCKETS = [
    ("Eligible", "Eligible"),
    ("Conditionally Eligible", "Conditionally"),
    ("Not Eligible", "Not Eligible"),
]
# What marks a status as a violation.
VIOLATION_MARKS = ("Blocked", "Violation")
# Fixed value: transactions shown.
RECENT = 10


def is_violation(status: Column) -> Column:
    return F.contains(status, F.lit(VIOLATION_MARKS[0])) | F.contains(status, F.lit(VIOLATION_MARKS[1]))


# Counters that add up over parts of a log; `figures` are worked out from their sums.
COUNTERS = ("total", "eligible", "conditional", "not_eligible", "violations", "latency_sum")


def counted() -> list[Column]:
    """The counters as aggregates. Partial sums per task, so only counters are shuffled."""
    decision = F.col("decision")
    return [
        F.count("*").alias("total"),
        F.count_if(decision == "Eligible").alias("eligible"),
        F.count_if(decision == "Conditionally Eligible").alias("conditional"),
        F.count_if(decision == "Not Eligible").alias("not_eligible"),
        F.count_if(is_violation(F.col("guardrail_status"))).alias("violations"),
        F.sum(F.coalesce(F.col("latency"), F.lit(0.0))).alias("latency_sum"),
    ]


def figures(sums: DataFrame) -> DataFrame:
    """The figures of one row of counters; zeros where nothing was counted."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return sums.select(
        *[whole(c) for c in ("total", "eligible", "conditional", "not_eligible")],
        F.coalesce(F.round(F.try_divide(100.0 * F.col("eligible"), F.col("total"))), F.lit(0.0)).cast("bigint").alias("approval_rate"),
        whole("violations"), F.coalesce(F.col("total") - F.col("violations"), F.lit(0)).cast("bigint").alias("compliant"),
        F.coalesce(F.round(F.try_divide(F.col("latency_sum"), F.col("total")), 2), F.lit(0.0)).alias("avg_latency"),
    )


def kpi_summary(log: DataFrame) -> DataFrame:
    """One row; zeros for an empty log."""
    return figures(log.agg(*counted()))


def decision_distribution(log: DataFrame) -> DataFrame:
    """The three buckets in fixed order, zero-filled: one pass over the log, then three rows."""
    counts = log.agg(*[F.count_if(F.col("decision") == d).alias(f"n{i}") for i, (d, _) in enumerate(BUCKETS)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("name"), F.col(f"n{i}").alias("count"))
        for i, (_, name) in enumerate(BUCKETS)
    ])
    return counts.select(F.inline(rows))


def recent_transactions(log: DataFrame, n: int = RECENT) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("application_id")).limit(n).select(
        "application_id", "timestamp", "decision", "guardrail_status", "latency"
    )
