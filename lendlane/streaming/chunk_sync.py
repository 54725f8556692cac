"""Keeping an index of passages in step with a changing table of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.operators.embed import Embedder
from lendlane.streaming import slots

# Columns of the stored index beside those of the passages.
ORDER, DELETED = "sync_order", "sync_deleted"
# Folders of one tier that are merged into one of the next.
MERGED_AT_ONCE = 4


def sync_chunks(change_stream: DataFrame, index: str, checkpoint: str, order: Column, deleted: Column | None = None,
                embedder: Embedder | None = None, key: str = "chunk_id", merged_at_once: int = MERGED_AT_ONCE) -> None:
    """Take in the changes that arrived since the last call, keyed by `key`.

    `order` tells which of two changes to a passage is the later one (a time or a
    change number); `deleted` marks changes that take the passage out. Of changes
    at the same time a delete counts, then the greatest text, so that the outcome
    does not depend on arrival. Every micro-batch is written as a folder of its own. When `merged_at_once` folders of a tier
    have piled up, they become one of the next tier, with the last change per key: a row is rewritten once a
    tier, and the folders that are read stay few, as the logarithm of the batches. Which folders count is written last, so
    readers see whole states, and a batch that has to be run again begins from the state before it.

    An index belongs to its checkpoint. Folders that were merged are left for readers under way; let them expire by age.
    """
    kept = change_stream.columns
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    marked = change_stream.select(*kept, order.alias(ORDER), gone.alias(DELETED))

    def upsert(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        rows = _latest(batch, key)
        if embedder is not None:
            rows = embedder.embed(rows)
        folder = f"versions/0-{version}-{version}"
        rows.write.mode("overwrite").parquet(f"{index}/{folder}")
        folders = [*live_folders(spark, index, version), folder]
        while len(folders) >= merged_at_once and len({_tier(f) for f in folders[-merged_at_once:]}) == 1:
            some = folders[-merged_at_once:]
            (tier, first, _), (*_, last) = _parts(some[0]), _parts(some[-1])
            merged = f"versions/{tier + 1}-{first}-{last}"
            _latest(spark.read.parquet(*[f"{index}/{f}" for f in some]), key).write.mode("overwrite").parquet(f"{index}/{merged}")
            folders = [*folders[:-merged_at_once], merged]
        _publish(spark, index, folders, version)

    query = (
        marked.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _parts(folder: str) -> tuple[int, int, int]:
    tier, first, last = folder.removeprefix("versions/").split("-")
    return int(tier), int(first), int(last)


def _tier(folder: str) -> int:
    return _parts(folder)[0]


def _publish(spark: SparkSession, index: str, folders: list[str], version: int) -> None:
    slots.publish(spark.createDataFrame([(folders,)], "folders array<string>"), f"{index}/head", version)


def live_folders(spark: SparkSession, index: str, before: int | None = None) -> list[str]:
    """The folders that make up the index, oldest first."""
    head = slots.newest(spark, f"{index}/head", before)
    row = head.first() if head is not None else None
    return list(row.folders) if row else []


def _latest(changes: DataFrame, key: str) -> DataFrame:
    """The last change per key; reduced per task before the shuffle."""
    others = [ORDER, DELETED, *(c for c in changes.columns if c not in (key, ORDER, DELETED))]
    return changes.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, "row.*")


def _current(spark: SparkSession, index: str, key: str) -> DataFrame:
    folders = live_folders(spark, index)
    if not folders:
        raise ValueError(f"nothing was synced to {index} yet")
    return _latest(spark.read.parquet(*[f"{index}/{f}" for f in folders]), key)


def current_index(spark: SparkSession, index: str, key: str = "chunk_id") -> DataFrame:
    """The newest state of every passage that has not been taken out."""
    return _current(spark, index, key).where(~F.col(DELETED)).drop(ORDER, DELETED)


def new_chunks(chunks: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Passages the index does not have yet."""
    return chunks.join(index.select(key), key, "left_anti")


def compact(spark: SparkSession, index: str, target: str, key: str = "chunk_id") -> None:
    """Write the current index to `target` as a single folder, to start the next syncs from.

    Deletes stay in it: an older change may still arrive.
    """
    tier = 1 + max(_tier(f) for f in live_folders(spark, index))
    folder = f"versions/{tier}-0-0"
    _current(spark, index, key).write.mode("overwrite").parquet(f"{target}/{folder}")
    _publish(spark, target, [folder], -1)
