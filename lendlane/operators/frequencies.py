"""Document frequencies kept by version, so that an index of passages learns on without reading old passages again.

A version holds, for each slot, how many of its passages have a term there, and how many
passages it has; passages it takes away count as less. Versions add up: the sums are what a
fit over all passages that are left would find. A version is at most a row for each slot and
one more, whatever its passages number, and is replaced when it is written again. A NULL text is a
passage without terms.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlane.operators.embed import DIMENSIONS, Embedder, term_slots

# What the number of passages is filed under, beside the slots.
PASSAGES = -1
COUNTS = "slot int, passages long, version long"


def counted(passages: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Of each slot, the passages with a term in it (`slot`, `passages`); all passages under `PASSAGES`."""
    slots = F.array_distinct(term_slots(F.coalesce(F.col(text), F.lit("")), dimensions))
    one = passages.select(F.explode(F.array_append(slots.cast("array<int>"), F.lit(PASSAGES))).alias("slot"))
    return one.groupBy("slot").agg(F.count("*").alias("passages"))


def write_version(folder: str, version: int, added: DataFrame, removed: DataFrame | None = None, text: str = "text",
                  dimensions: int = DIMENSIONS) -> None:
    """Count the passages that a version brings and takes away, and file the difference."""
    counts = counted(added, text, dimensions)
    if removed is not None:
        gone = counted(removed, text, dimensions).select("slot", (-F.col("passages")).alias("passages"))
        counts = counts.unionByName(gone).groupBy("slot").agg(F.sum("passages").alias("passages"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def frequencies(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The sums over all versions, or those up to one."""
    versions = spark.read.schema(COUNTS).parquet(folder)
    if upto is not None:
        versions = versions.where(F.col("version") <= upto)
    return versions.groupBy("slot").agg(F.sum("passages").alias("passages"))


def weights(counts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """`slot`, `passages` and the inverse document frequency `idf` of every slot; one number, their total, comes to the driver."""
    total = counts.where(F.col("slot") == PASSAGES).agg(F.sum("passages")).first()[0] or 0
    slots = counts.sparkSession.range(dimensions).select(F.col("id").cast("int").alias("slot"))
    n = F.coalesce("passages", F.lit(0)).cast("long")
    return slots.join(counts, "slot", "left").select("slot", n.alias("passages"), F.log(F.lit(float(total + 1)) / (n + 1)).alias("idf"))


def embedder(spark: SparkSession, folder: str, upto: int | None = None, dimensions: int = DIMENSIONS) -> Embedder:
    """An embedder that weighs by the versions' sums; at most a number for each slot comes to the driver."""
    counts = {r.slot: r.passages for r in frequencies(spark, folder, upto).collect()}
    total = counts.get(PASSAGES, 0)
    idf = [math.log((total + 1) / (counts.get(slot, 0) + 1)) for slot in range(dimensions)]
    return Embedder(dimensions, ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="e_counts", outputCol="e_weights"))
