"""Conversations as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substr(role, F.lit(2))), F.lit(": "), text)


def chat_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Ordered history text, one row per conversation: the history is one value, however long it gets."""
    entry = F.struct(F.col(turn).alias("turn"), turn_line(F.col(role), F.col(text)).alias("line"))
    return turns.select(F.col(conversation), entry.alias("entry")).groupBy(conversation).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e.getField("line")), "\n").alias("history"),
        F.count("*").alias("turns"),
    )
