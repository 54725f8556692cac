"""What several of these operators need: words, holdouts, stored tables, sorted groups, objects kept by a worker."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlane.session import shared_folder

# Fixed value: what separates words, in Java's and RE2's notation.
BLANKS = r"[\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name among the installed public ones."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; NULL for a NULL id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(parts)


def held_out(id_column: Column, parts: int) -> Column:
    """Whether a row is kept out of learning. A NULL id is not."""
    return F.coalesce(remainder(id_column, parts) == 1, F.lit(False))


def whole_row(columns: list[str]) -> Column:
    """All columns as one struct, whatever characters their names hold."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it from there: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by_worker(name: str, make: Callable[[], object]):
    """An object that a Python worker keeps for later tasks; only the last one asked for, so a worker's memory is bounded."""
    keep = sys.modules.setdefault("lendlane_kept", types.ModuleType("lendlane_kept"))
    if getattr(keep, "name", None) != name:
        keep.name = keep.value = None  # let go of the old one before the new one is made
        keep.name, keep.value = name, make()
    return keep.value


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, one table each, from batches sorted by these keys.

    Holds one batch and the group that is still open.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
