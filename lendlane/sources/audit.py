"""The audit log: appended in batches, read whole or as the latest row per application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.schemas import AUDIT_LOG

AUDIT_TABLE = "loan_assessment_logs"


def append(rows: DataFrame, table: str = AUDIT_TABLE, format: str = "parquet") -> bool:
    """Append a batch of audit rows."""
    rows.select(*AUDIT_LOG.names).write.format(format).mode("append").saveAsTable(table)
    return True


def read(spark: SparkSession, table: str = AUDIT_TABLE) -> DataFrame:
    """The log; an empty one if nothing was ever logged."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], AUDIT_LOG)
    return spark.table(table)


def latest(log: DataFrame, key: str = "application_id", order: str = "timestamp") -> DataFrame:
    """The latest row per key, as if every append had replaced the row before.

    An aggregate, not a window: each task reduces its own rows first, so a key
    with very many rows ships one row per task. Equal times are settled by the
    rest of the row, so the answer does not depend on arrival.
    """
    others = [c for c in log.columns if c not in (key, order)]
    newest = F.max(F.struct(order, *others))
    return log.groupBy(key).agg(newest.alias("newest")).select(key, "newest.*").select(*log.columns)
