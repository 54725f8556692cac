"""Figures over an audit log kept by day, from counters that add up.

The log lies in folders by day and batch. Each folder is counted once; its counters are kept, and the figures over
any days are sums of them. The last transactions are read from the newest days only, as many as hold enough rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.plans import kpi
from lendlane.schemas import AUDIT_LOG

DAY, BATCH = "log_day", "log_batch"
KEPT = f"{DAY} string, {BATCH} string, {', '.join(f'{c} double' if c == 'latency_sum' else f'{c} long' for c in kpi.COUNTERS)}"
NO_DAY = "none"


def append_by_day(rows: DataFrame, log: str, batch_id: str) -> None:
    """Append a batch of audit rows; run again, it replaces what it wrote. Rows without a time have a folder of their own."""
    day = F.coalesce(F.substring("timestamp", 1, 10), F.lit(NO_DAY))
    placed = rows.select(*AUDIT_LOG.names, day.alias(DAY), F.lit(batch_id).alias(BATCH))
    placed.repartition(DAY, F.pmod(F.xxhash64("application_id"), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(log)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log with its day and batch; filters on these prune folders."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in AUDIT_LOG.fields)
    return spark.read.schema(f"{shape}, {DAY} string, {BATCH} string").parquet(log)


def kept_counters(spark: SparkSession, counters: str) -> DataFrame:
    try:
        return spark.read.schema(KEPT).parquet(counters)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], KEPT)
        raise


def refresh(spark: SparkSession, log: str, counters: str) -> int:
    """Count the folders of the log that have not been counted; tells how many there were."""
    rows = read_log(spark, log)
    # Folder names only: one row for each folder of the log.
    there = {(r[0], r[1]) for r in rows.select(DAY, BATCH).distinct().collect()}
    known = {(r[0], r[1]) for r in kept_counters(spark, counters).select(DAY, BATCH).collect()}
    new = sorted(there - known)
    if new:
        _counted(rows, new).write.mode("append").parquet(counters)
    return len(new)


def _counted(rows: DataFrame, new: list[tuple[str, str]]) -> DataFrame:
    """The counters of some folders of the log. Rows are summed where they are read; one row a folder is shuffled, and written in one file."""
    days = sorted({d for d, _ in new})
    batches = sorted({b for _, b in new})
    wanted = rows.sparkSession.createDataFrame(new, "w_day string, w_batch string")
    # Folders of other days and batches are not read; of those that are, the join takes the pairs.
    some = rows.where(F.col(DAY).isin(days) & F.col(BATCH).isin(batches)).join(
        F.broadcast(wanted), (F.col(DAY) == F.col("w_day")) & (F.col(BATCH) == F.col("w_batch")), "left_semi")
    # Dealt to one task after counting, by a shuffle: a coalesce would draw the counting itself into that task.
    return some.groupBy(DAY, BATCH).agg(*kpi.counted()).select(DAY, BATCH, *kpi.COUNTERS).repartition(1)


def days_summary(spark: SparkSession, counters: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The figures of all days, or of those from `first` to `last`."""
    kept = kept_counters(spark, counters)
    some = kept if first is None else kept.where(F.col(DAY) >= first)
    some = some if last is None else some.where(F.col(DAY) <= last)
    return kpi.figures(some.agg(*[F.sum(c).alias(c) for c in kpi.COUNTERS]))


def by_day(spark: SparkSession, counters: str) -> DataFrame:
    """Counters of each day."""
    return kept_counters(spark, counters).groupBy(DAY).agg(*[F.sum(c).alias(c) for c in kpi.COUNTERS])


def recent_from_days(spark: SparkSession, log: str, counters: str, n: int = kpi.RECENT) -> DataFrame:
    """The last `n` transactions; older days than hold them are not read. Rows without a time come last."""
    days = by_day(spark, counters).where(F.col(DAY) != NO_DAY).select(DAY, "total").orderBy(F.desc(DAY)).limit(n).collect()
    rows, held = read_log(spark, log), 0
    for day, total in days:
        held += total
        if held >= n:
            rows = rows.where((F.col(DAY) >= day) & (F.col(DAY) != NO_DAY))
            break
    return kpi.recent_transactions(rows, n)
