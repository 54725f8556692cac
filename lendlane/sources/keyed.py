"""A stored table with one row per key, into which batches are merged.

Rows lie in folders by a hash of their key. A batch rewrites only the folders that its keys fall into, by
dynamic partition overwrite; the other folders' files stay as they are. The newer of two rows of a key stays, by the order column, then by
the rest of the row, so the outcome does not depend on arrival.

A merge is first written beside the table, then put in its place, then marked as done. A job that is run again
after a failure goes on from what was written; a batch that was merged already changes nothing, whatever
came after it. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.sources.audit import latest

BUCKET = "key_bucket"
# Folders of a table. More of them, and a small batch touches less.
BUCKETS = 256


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table in a folder, or None if there is no such folder."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _marked(spark: SparkSession, mark: str) -> bool:
    marks = _read(spark, mark, "done boolean")
    return marks is not None and not marks.isEmpty()


def _mark(spark: SparkSession, mark: str) -> None:
    spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.mode("overwrite").parquet(mark)


def upsert(batch: DataFrame, folder: str, batch_id: str, key: str = "application_id", order: str = "timestamp",
           buckets: int = BUCKETS) -> bool:
    """Merge a batch into the table at `folder`; tells whether it was new. `buckets` stays the same for a table's life."""
    spark = batch.sparkSession
    merged, written, done = (f"{folder}/{kind}/batch={batch_id}" for kind in ("merges", "written", "done"))
    if _marked(spark, done):
        return False
    if not _marked(spark, written):
        new = latest(batch, key, order).withColumn(BUCKET, bucket_of(key, buckets))
        # At most as many numbers as there are folders.
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        table = _read(spark, f"{folder}/rows")
        both = new if table is None else new.unionByName(table.where(F.col(BUCKET).isin(touched)).select(*new.columns))
        newest = latest(both.drop(BUCKET), key, order).withColumn(BUCKET, bucket_of(key, buckets))
        newest.write.mode("overwrite").parquet(merged)
        _mark(spark, written)
    rows = spark.read.parquet(merged).repartition(BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{folder}/rows")
    _mark(spark, done)
    return True


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table: one row per key."""
    return spark.read.parquet(f"{folder}/rows").drop(BUCKET)


def find(spark: SparkSession, folder: str, keys: list, key: str = "application_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows of a few keys; only their folders are read."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias(key)).select(bucket_of(key, buckets)).distinct()
    numbers = [r[0] for r in wanted.collect()]
    return spark.read.parquet(f"{folder}/rows").where(F.col(BUCKET).isin(numbers) & F.col(key).isin(keys)).drop(BUCKET)
