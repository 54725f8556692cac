"""Joining a table that may have hot keys with a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join `left` to `right`, which has at most one row per `key`.

    A plain join: adaptive execution splits the partitions of hot keys, NULL
    included, from their measured sizes, and nothing is counted before.
    """
    return left.join(right, key, how)
