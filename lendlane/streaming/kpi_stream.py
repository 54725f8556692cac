"""Audit figures kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lendlane.plans import kpi
from lendlane.session import shared_folder
from lendlane.streaming import slots

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Counters as an application adds to them or takes back; the latency exact, so that what is taken back leaves no trace.
CHANGES = "total long, eligible long, conditional long, not_eligible long, violations long, latency_sum decimal(38,9)"


def refresh_kpis(spark: SparkSession, log_stream: DataFrame, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Take in all rows that are there now and return the figures over everything seen so far.

    The state is one row of counters. Run again with the same `output` and
    `checkpoint`, it takes in only what is new.
    """
    output = output or shared_folder(spark, "kpi")
    checkpoint = checkpoint or shared_folder(spark, "kpi-checkpoint")
    query = (
        kpi.kpi_summary(log_stream).writeStream.outputMode("complete")
        .foreachBatch(lambda figures, batch: slots.publish(figures, output, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return newest_figures(spark, output)


def newest_figures(spark: SparkSession, output: str) -> DataFrame:
    """The figures of the last batch; two rows are read."""
    return slots.newest(spark, output)


class _LastRow(StatefulProcessor):
    """Keeps the last row of each key, and tells how the counters change when a later one comes."""

    def __init__(self, key: str, order: str, columns: list[str], schema: str):
        self.order = [order, *[c for c in columns if c not in (key, order)]]
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def _place(self, row: tuple) -> tuple:
        """Rows of a key in order; NULL before all else."""
        return tuple((v is not None, v if v is not None else 0) for v in row)

    def _counters(self, row: tuple, sign: int) -> list:
        from decimal import Decimal

        at = dict(zip(self.order, row))
        status = at["guardrail_status"] or ""
        counts = [True, *[at["decision"] == name for name, _ in kpi.BUCKETS], any(mark in status for mark in kpi.VIOLATION_MARKS)]
        return [sign * int(c) for c in counts] + [sign * Decimal(repr(at["latency"] or 0.0)).quantize(Decimal(1).scaleb(-9))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        before = self.last.get() if self.last.exists() else None
        before = None if before is None else tuple(plain(v) for v in before)
        newest = before
        for part in rows:
            for row in part[self.order].itertuples(index=False, name=None):
                row = tuple(plain(v) for v in row)
                if newest is None or self._place(row) > self._place(newest):
                    newest = row
        if newest != before:
            self.last.update(newest)
            change = self._counters(newest, 1)
            if before is not None:
                change = [a + b for a, b in zip(change, self._counters(before, -1))]
            yield pd.DataFrame([change], columns=list(kpi.COUNTERS))

    def close(self) -> None:
        pass


def refresh_latest_kpis(spark: SparkSession, log_stream: DataFrame, key: str = "application_id", order: str = "timestamp",
                        output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """As `refresh_kpis`, over the latest row of each key only: a later row takes the place of the one before it.

    The state is the last row of each key, in RocksDB. Each key that has a later row adds what this changes; a
    batch adds these changes to the counters of the batch before. Equal to `kpi_summary` over `audit.latest`,
    whatever the order of arrival and however often a batch is run again.
    """
    output = output or shared_folder(spark, "kpi-latest")
    checkpoint = checkpoint or shared_folder(spark, "kpi-latest-checkpoint")
    kinds = {f.name: f.dataType.simpleString() for f in log_stream.schema.fields}
    columns = [order, *[c for c in log_stream.columns if c not in (key, order)]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def publish(changes: DataFrame, batch: int) -> None:
        # One row of counters, taken up before its folder may be written anew.
        before = slots.newest(changes.sparkSession, output, batch)
        rows = before.collect() if before is not None else []
        both = changes.select(*kpi.COUNTERS).unionByName(changes.sparkSession.createDataFrame(rows, CHANGES))
        sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, kind in
                          (part.split(" ") for part in CHANGES.split(", "))])
        slots.publish(sums, output, batch)

    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        changes = log_stream.groupBy(key).transformWithStateInPandas(
            _LastRow(key, order, log_stream.columns, schema), CHANGES, "Update", "None")
        query = (
            changes.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    sums = slots.newest(spark, output)
    return kpi.figures(sums.withColumn("latency_sum", F.col("latency_sum").cast("double")))
