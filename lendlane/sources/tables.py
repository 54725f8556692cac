"""Writing and reading tables. The format is a parameter; parquet needs nothing installed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_namespace(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def overwrite(df: DataFrame, table: str, format: str = "parquet") -> None:
    df.write.format(format).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def create_if_absent(spark: SparkSession, table: str, rows: Callable[[], DataFrame], format: str = "parquet") -> bool:
    """Write `rows()` unless the table exists; tells whether it was written."""
    if spark.catalog.tableExists(table):
        return False
    rows().write.format(format).saveAsTable(table)
    return True


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
