"""The newest outcome of a stream's batches, in two folders written in turn.

A batch overwrites the folder of the batch before the last one, so the outcome before it stays readable until its own
is whole, a batch that is run again finds what it started from, and readers look at two rows whatever the stream's age.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_BATCH, _SLOT = "slot_batch", "slot"


def publish(outcome: DataFrame, folder: str, batch: int) -> None:
    """Keep `outcome`, one row, as that of `batch`."""
    outcome.withColumn(_BATCH, F.lit(batch).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{_SLOT}={batch % 2}")


def newest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The row of the last batch, or of the last one before another; None if there is none."""
    try:
        # A folder that is being written anew is passed over.
        slots = spark.read.option("ignoreMissingFiles", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    names = [c for c in slots.columns if c not in (_BATCH, _SLOT)]
    some = slots if before is None else slots.where(F.col(_BATCH) < before)
    found = some.agg(F.max_by(F.struct(*names), _BATCH).alias("newest")).where("newest IS NOT NULL").select("newest.*")
    return None if before is not None and found.isEmpty() else found
